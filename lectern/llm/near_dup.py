"""Near-duplicates by min-max hashing.

Each permutation of a document's shingles gives two signature values, its least and its greatest
image, so half as many hashes as values are worked out. Bands of those values propose pairs,
whole shingle sets confirm them.

1. Documents with equal sets are folded into the one with the least id.
2. Every document of the rest meets the least document of all its buckets; confirmed links are
   merged. Groups of copies shrink to one component here, with one pair a document.
3. The same with the greatest document of each bucket that still holds different components.
4. Pairs in different components that share at least two buckets are confirmed, unless their rarest
   shingles already show that they can't be similar enough.

No pair inside a component is made in step 4, and copies that have drifted apart, or documents that
merely share a passage, have other rare shingles, so rows stay in proportion to the documents.

With 80 bands of 7 values a pair at similarity 0.8 shares on average 17 buckets; it is missed,
with fewer than two, at a chance of about 2e-7, and every pair above that is likelier found.

Texts without words and null texts have no shingles and no links. Rows with a null id are
returned unlinked. Repeated rows with one id are copies of each other. Other columns are not
read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import let, lower_ascii, positions, stored, with_row_key, without, words
from lectern.llm.components import components

BANDS, ROWS = 80, 7
SLICE = 1 << 17
#: Up to this many ids (8 bytes each) are sent to every executor to find their texts; more are shuffled.
BROADCAST_IDS = 2_000_000
SIGNED = "id long, n long, f1 long, f2 long, keys array<long>"


def shingles(text: Column, size: int) -> Column:
    """Distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one run."""
    def runs(h: Column) -> Column:
        full = F.transform(positions(F.size(h) - (size - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
        return (
            F.when(F.size(h) >= size, F.array_distinct(full))
            .when(F.size(h) > 0, F.array(F.xxhash64(h)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w)), runs)


def min_max_keys(values: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> np.ndarray:
    """Band keys of sets that lie one after the other in ``values``, none empty: [sets, bands].
    The first half of the bands is made of least images, the second of greatest ones."""
    n = bands * rows // 2
    draw = np.random.default_rng(seed)
    factor = draw.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    shift = draw.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    mix = draw.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
    salt = draw.integers(0, 1 << 63, bands, dtype=np.uint64)
    low = (values.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    image = np.empty_like(low)
    found = np.empty((2 * n, len(starts)), np.uint32)
    for p in range(n):
        np.multiply(low, factor[p], out=image)
        np.add(image, shift[p], out=image)
        np.minimum.reduceat(image, starts, out=found[p])
        np.maximum.reduceat(image, starts, out=found[n + p])
    banded = found.reshape(bands, rows, len(starts)).astype(np.uint64)
    keys = (banded * mix[None, :, None]).sum(axis=1, dtype=np.uint64) + salt[:, None]
    keys ^= keys >> np.uint64(29)
    return (keys * mix[0]).T.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sets = batch.column("id"), batch.column("shingles")
        offsets = sets.offsets.to_numpy().astype(np.int64)
        values = sets.values.to_numpy()
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            part, starts = values[offsets[at]:offsets[to]], (offsets[at:to] - offsets[at])
            keys = min_max_keys(part, starts)
            unsigned = part.view(np.uint64)
            mixed = (unsigned ^ (unsigned >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, to - at), pa.array(np.diff(offsets[at:to + 1])),
                    pa.array(np.add.reduceat(unsigned, starts).view(np.int64)),
                    pa.array(np.add.reduceat(mixed ^ (mixed >> np.uint64(33)), starts).view(np.int64)),
                    pa.ListArray.from_arrays(np.arange(len(starts) + 1, dtype=np.int32) * BANDS, pa.array(np.ascontiguousarray(keys).reshape(-1))),
                ],
                names=["id", "n", "f1", "f2", "keys"],
            )
            at = to


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b")).alias("total")).filter(
        F.lit(100) * F.col("shared") >= percent * (F.col("total") - F.col("shared"))
    ).select("a", "b")


def _mixed(met: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with the component ``c`` and the
    greatest document of the bucket."""
    labels = components(links)
    known = met.join(labels, met["rep"] == labels["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    ends = known.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("rep").alias("high"))
    return known.join(ends.filter("c0 < c1").select("key", "high"), "key")


def _close(m: Column, n: Column, percent: int) -> Column:
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def _by_rarest(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``docs`` (rep, n, c, keys) in different components that share two buckets or
    more and one of the rarest shingles of each.

    A set that is similar enough to another can lack at most n - ceil(n * percent / 100) of its
    shingles there, so of one more than that, the rarest, the other has at least one, and so the
    other way round with the same order of rarity. Common shingles make no pairs that way.
    """
    each = docs.select("rep", "n", "c").join(sets, F.col("rep") == F.col("id")).select("rep", "n", "c", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("times"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    ranked = each.join(often, "shingle").withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("times", "shingle")))
    head = ranked.filter(F.col("nth") <= F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1).filter("c0 < c1")
    head = stored(head.select("shingle", "rep", "n", "c", "nth"))
    x = head.select("shingle", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("nth").alias("ia"))
    y = head.select("shingle", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("nth").alias("ib"))
    shared = F.floor((percent * (F.col("na") + F.col("nb")) + 99 + percent) / (100 + percent))  # at the least, if similar enough
    early = (F.col("ia") <= F.col("na") - shared + 1) & (F.col("ib") <= F.col("nb") - shared + 1)
    pairs = x.join(y, "shingle").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _close(F.col("na"), F.col("nb"), percent) & early)
    keys = docs.select("rep", "keys")
    both = pairs.select("a", "b").distinct().join(keys.toDF("a", "of_a"), "a").join(keys.toDF("b", "of_b"), "b")
    return both.filter(F.size(F.array_intersect("of_a", "of_b")) >= 2).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least id that it is linked to,
    directly or not, or its own) and kept (it is that one)."""
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sets = source.filter("id IS NOT NULL").select("id", shingles(F.col("text"), size).alias("shingles")).filter(F.size("shingles") > 0)
    signed = stored(sets.mapInArrow(_sign, SIGNED))

    same = ["n", "f1", "f2"]
    folded = stored(signed.groupBy(*same).agg(F.min_by("keys", "id").alias("keys"), F.min("id").alias("rep")))
    buckets = folded.select("rep", "n", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    met = stored(buckets.join(shared.select("key"), "key"))

    involved = stored(met.select("rep").distinct())
    few = involved.count() <= BROADCAST_IDS
    whole = source.filter("id IS NOT NULL").join(F.broadcast(involved) if few else involved, F.col("id") == F.col("rep"), "left_semi")
    own_sets = stored(whole.select("id", shingles(F.col("text"), size).alias("shingles")))

    first = met.join(met.groupBy("key").agg(F.min("rep").alias("low")), "key").groupBy(F.col("rep").alias("b")).agg(F.min("low").alias("a"))
    links = stored(_confirmed(first.filter("a < b"), own_sets, percent))

    mixed = stored(_mixed(met, links))
    tops = mixed.filter("rep = high").select("key", F.col("rep").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"))
    pairs = mixed.join(tops, "key").filter((F.col("c") != F.col("cb")) & _close(F.col("n"), F.col("nb"), percent))
    links = stored(links.unionByName(_confirmed(pairs.select(F.col("rep").alias("a"), "b").distinct(), own_sets, percent)))

    mixed = stored(_mixed(met, links).groupBy("rep", "n", "c").agg(F.collect_set("key").alias("keys")))  # a row has BANDS keys at most
    links = stored(links.unionByName(_confirmed(_by_rarest(mixed, own_sets, percent), own_sets, percent)))
    labels = components(links)

    owners = folded.select(*same, "rep").join(labels, F.col("rep") == F.col("node"), "left").select(
        *same, F.coalesce("component", "rep").alias("component_id"))
    placed = signed.select("id", *same).join(owners, same).select("id", F.col("n").alias("n_shingles"), "component_id")
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    n_bare = F.when(wordless, 0).otherwise(F.size(shingles(F.col("text"), size))).cast("long")
    alone = source.filter(F.col("id").isNull() | wordless).select("id", n_bare.alias("n_shingles"), F.col("id").alias("component_id"))
    return placed.unionByName(alone).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all columns and one row of each group of near-duplicates, the one with the least
    id (null ids last). Rows count, not ids: repeated rows are copies of each other, rows of one id
    with different texts are different documents, and rows with a null id take part."""
    keyed, row = with_row_key(docs)
    copies = stored(near_duplicates(keyed, row, text, size, percent).filter("component_id IS NOT NULL AND NOT kept").select(
        F.col("doc_id").alias("member"), "component_id"))
    members = copies.unionByName(copies.select(F.col("component_id").alias("member"), "component_id").distinct())
    named = members.join(keyed.select(F.col(row).alias("member"), F.col(doc_id).alias("own_id")), "member")
    best = named.groupBy("component_id").agg(F.min_by("member", F.struct(F.col("own_id").isNull(), "own_id", "member")).alias("best"))
    gone = members.join(best, "component_id").filter("member <> best").select("member")
    return without(keyed, gone, row).drop(row)
