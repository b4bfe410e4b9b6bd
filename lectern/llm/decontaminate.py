"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only.

Fixed masks over 12 tokens each ignore every third one, so that wherever 12 tokens of a document
and a benchmark text differ in one place at most, some mask sees them as equal. Masked windows of
both sides meet by hash; around each hit the two texts are then laid over one another and compared
token by token: an overlap counts if its best stretch (1 for an equal token, -2 for another)
reaches the score of 12 tokens with one substitution.

Masks share their work: neighbours are hashed in pairs once, and four pairs, three tokens apart,
serve the mask that ignores the third tokens of windows that begin there and, one place on, the
mask that ignores the first ones. So three masks are two families of hashes.

Documents are read once. A bitmap of the benchmark's window hashes, sized by their number, lets
each document test its windows on its own row; only the few that pass are joined, on the hash.

Tokens are runs of letters and digits, A-Z lower-cased. Benchmark texts of 5 to 11 tokens are
looked for as a whole, without substitutions; shorter ones, empty and null ones match nothing.
Null document texts are empty. Rows with a null id are not reported. Repeated rows are reported
once. Other columns are not read. If either table is empty, so is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import let, lower_ascii, positions, stored, with_row_key, without

WINDOW, SHORTEST = 12, 5
SUBSTITUTION = -2
LEAST_SCORE = WINDOW - 1 + SUBSTITUTION
#: Bits per benchmark window in the bitmap, probes, and the bitmap's least and greatest size (log2). Above
#: about a million windows the largest bitmap fills up: it then spares less work, and results stay the same.
BITS_PER_WINDOW, PROBES, LEAST_BITS, MOST_BITS = 128, 3, 16, 27
#: Window hashes of this many benchmark rows (16 bytes each) are sent to every executor; more are shuffled.
BROADCAST_ROWS = 2_000_000


def token_hashes(text: Column) -> Column:
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _families(h: Column) -> Column:
    """Hashes at each place of a text: of the masks that ignore every third token from the third or,
    a window before, from the first on; and of the one that ignores them from the second on."""
    def of_pairs(p: Column) -> Column:
        at = lambda i, o: F.get(p, i + o)
        outer = F.transform(p, lambda x, i: F.xxhash64(F.lit(0), x, at(i, 3), at(i, 6), at(i, 9)))
        inner = F.transform(h, lambda x, i: F.xxhash64(F.lit(1), x, at(i, 2), at(i, 5), at(i, 8), F.get(h, i + (WINDOW - 1))))
        # Of the last places, where tokens are missing, none is used.
        usable = lambda c, n: F.when(F.size(h) >= WINDOW, F.slice(c, F.lit(1), F.greatest(F.size(h) - n, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
        return F.array(usable(outer, WINDOW - 2), usable(inner, WINDOW - 1))

    return let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))), of_pairs)


def _whole(h: Column, span: int, only_whole: bool) -> Column:
    """Hashes of all tokens from each place on."""
    size = F.when(F.size(h) == span, 1).otherwise(0) if only_whole else F.size(h) - (span - 1)
    return F.transform(positions(size), lambda i: F.xxhash64(F.lit(span + 100), *[F.get(h, i + o) for o in range(span)]))


def _hashes(h: Column, short: list[int], only_whole: bool) -> Column:
    """A list for each family: the two of the masks, then one for each short length."""
    return F.concat(_families(h), F.array(*[_whole(h, n, only_whole) for n in short])) if short else _families(h)


def _same_mask(at: Column, size: Column, item_at: Column, item_size: Column, family: Column) -> Column:
    """Whether the places of both sides begin a window of one mask; in the outer family the first
    place is only of one mask and the last one only of the other."""
    ends = ((at <= size - WINDOW) & (item_at <= item_size - WINDOW)) | ((at >= 1) & (item_at >= 1))
    return (family != 0) | ends


def _probes(value: Column, log2: int) -> list[Column]:
    return [F.shiftrightunsigned(value, 18 * k).bitwiseAND(F.lit((1 << log2) - 1)) for k in range(PROBES)]


def _bitmap(hashes: DataFrame, log2: int) -> DataFrame:
    """One row: the bits of all hashes as 64-bit words."""
    bits = hashes.select(F.explode(F.array(*_probes(F.col("hash"), log2))).alias("bit"))
    filled = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("value"))
    every = hashes.sparkSession.range(1 << (log2 - 6)).withColumnRenamed("id", "word")
    dense = every.join(filled, "word", "left").select("word", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    listed = F.array_sort(F.collect_list(F.struct("word", "value")))
    return dense.agg(F.transform(listed, lambda x: x["value"]).alias("bits"))


def _may_hit(bits: Column, value: Column, log2: int) -> Column:
    tests = [F.get(bits, F.shiftright(p, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))) != 0
             for p in _probes(value, log2)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _best_stretch(doc: Column, item: Column, shift: Column) -> Column:
    """The best stretch where the item is laid over the document from token ``shift`` on."""
    def step(acc: Column, x: Column) -> Column:
        points = F.when(x["same"], 1).otherwise(SUBSTITUTION)
        fresh = acc["now"] <= 0
        now, start = F.when(fresh, points).otherwise(acc["now"] + points), F.when(fresh, x["i"]).otherwise(acc["start"])
        better = now > acc["score"]
        return F.struct(
            now.alias("now"), start.alias("start"), F.when(better, now).otherwise(acc["score"]).alias("score"),
            F.when(better, start).otherwise(acc["first"]).alias("first"), F.when(better, x["i"]).otherwise(acc["last"]).alias("last"))

    laid = F.transform(item, lambda h, i: F.struct(
        i.alias("i"), F.coalesce((shift + i >= 0) & (F.get(doc, F.greatest(shift + i, F.lit(0))) == h), F.lit(False)).alias("same")))
    zero = F.struct(*[F.lit(0).alias(c) for c in ("now", "start", "score", "first", "last")])
    return F.aggregate(laid, zero, step)


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark text that overlap: doc_id, item_id, score, and the best
    stretch in the document, in tokens (first_token, n_tokens)."""
    spark = docs.sparkSession
    items = stored(
        benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), token_hashes(F.col(item_text)).alias("item"))
        .filter(F.size("item") >= SHORTEST).distinct())
    short = sorted(r[0] for r in items.select(F.size("item").alias("n")).filter(F.col("n") < WINDOW).distinct().collect())  # 7 at most
    of_items = F.flatten(F.transform(_hashes(F.col("item"), short, True), lambda c, k: F.transform(
        c, lambda v, i: F.struct(k.alias("family"), i.alias("at"), v.alias("hash")))))
    keyed = stored(items.select("item_id", F.size("item").alias("item_size"), F.explode(of_items).alias("w")).select(
        "item_id", "item_size", F.col("w.family").alias("family"), F.col("w.at").alias("item_at"), F.col("w.hash").alias("hash")))
    n = keyed.count()
    log2 = max(LEAST_BITS, min(MOST_BITS, (BITS_PER_WINDOW * max(n, 1)).bit_length()))

    source = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), token_hashes(F.col(text)).alias("doc"))
    bits = _bitmap(keyed.select("hash"), log2)  # one row of a fixed size
    tested = source.crossJoin(F.broadcast(bits))

    def passing(hashes: Column, family: Column) -> Column:
        """(family, at, hash) of the windows that pass the bitmap; each is tested once."""
        places = F.filter(F.transform(hashes, lambda x, i: F.when(_may_hit(F.col("bits"), x, log2), i)), lambda i: i.isNotNull())
        return F.transform(places, lambda i: F.struct(family.alias("family"), i.alias("at"), F.get(hashes, i).alias("hash")))

    windows = F.flatten(F.transform(_hashes(F.col("doc"), short, False), passing))
    likely = stored(tested.select("doc_id", "doc", windows.alias("windows")).filter(F.size("windows") > 0))

    found = likely.select("doc_id", F.size("doc").alias("size"), F.explode("windows").alias("w")).select(
        "doc_id", "size", F.col("w.family").alias("family"), F.col("w.at").alias("at"), F.col("w.hash").alias("hash"))
    known = F.broadcast(keyed) if n <= BROADCAST_ROWS else keyed
    met = found.join(known, ["family", "hash"]).filter(_same_mask(*[F.col(c) for c in ("at", "size", "item_at", "item_size", "family")]))
    laid = met.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    verified = laid.join(items, "item_id").join(likely.select("doc_id", "doc").dropDuplicates(), "doc_id")
    best = verified.select("doc_id", "item_id", "shift", F.size("item").alias("size"), _best_stretch(F.col("doc"), F.col("item"), F.col("shift")).alias("b"))
    enough = best.filter(F.col("b.score") >= F.least(F.lit(LEAST_SCORE), F.col("size")))
    top = enough.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("b", "shift"), F.struct(F.col("b.score"), -F.col("shift"))).alias("t"))
    return top.select(
        "doc_id", "item_id", F.col("t.b.score").cast("long").alias("score"), (F.col("t.shift") + F.col("t.b.first")).cast("long").alias("first_token"),
        (F.col("t.b.last") - F.col("t.b.first") + 1).cast("long").alias("n_tokens"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no benchmark text, with all their columns. Rows count, not ids: a
    row with a null id is tested, and of rows of one id only those that overlap go."""
    keyed, row = with_row_key(docs)
    return without(keyed, overlaps(keyed, benchmark, doc_id=row).select("doc_id"), row).drop(row)
