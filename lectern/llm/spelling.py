"""Spelling variants: words one code point apart, found by PartEnum signatures of their letters.

1. Words are counted over all texts.
2. A word's letters, without their order, are a binary vector: entry (letter, k) is set if the
   letter stands in the word k times at least. Words that differ by one inserted, deleted or
   replaced code point have vectors at a Hamming distance of 1 or 2.
3. PartEnum: letters are dealt into ``PARTS`` parts. For every choice of two parts, the entries of
   all other parts are a signature. Vectors at a distance of two or less differ in two parts at
   most, so they share a signature; classes of equal letters are equi-joined on it and their
   distance is counted.
4. Words of two classes are verified without comparing all with all: of two near words, what is
   left without the letter in which their classes differ is the same text (and, after a
   replacement, the letter stood at the same place), so that they meet by equi-join once more.
   Words of the same letters are never near.

Texts: null ones hold no words. A null id counts as an empty one in the draw of ``drop_letters``.
Repeated rows count as often as they stand there. Of words of equal n the smallest in code-point
order is the form. Other columns are not read. An empty table gives no words.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import let, lower_ascii, stored

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_POINTS, LEAST_COUNT, TIMES = 6, 5, 5
#: Parts of the letters. With more parts a signature holds more of the word, and there are more of them: 28 for 8.
PARTS, DISTANCE = 8, 2
#: Dealt to the parts in turn, to and fro; other letters go by their code point.
BY_FREQUENCY = "etaoinsrhldcumfpgwybvkxjqz"
#: A word's form is TIMES as frequent at least, so that a chain of forms over counts below 2 ** 63 has under 2 ** 5 links.
DOUBLINGS = 5
NEAR = "word string, n long, near string, near_n long"


def drop_letters(word: Column, doc_id: Column, one_in: int = 199) -> Column:
    """The word without its code point ``h % length`` where ``one_in`` divides ``h``, the crc32 of
    ``<doc_id>:<word>``: a typing error drawn from the text alone."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", one_in: int = 199, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of ``LEAST_POINTS`` code points and ``least`` occurrences or more."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{LEAST_POINTS},}}"), F.lit(0))
    found = docs.select(F.col(doc_id).alias("id"), F.explode(runs).alias("run"))
    words = found.select(drop_letters(lower_ascii(F.col("run")), F.col("id"), one_in).alias("word"))
    counted = words.filter(F.length("word") >= LEAST_POINTS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least)


def letters_of(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def vector_of(letters: Column) -> Column:
    """Entries set, ``<letter><k>``, of a word's sorted letters."""
    return let(F.split(letters, ""), lambda a: F.transform(a, lambda c, i: F.concat(c, (i - F.array_position(a, c) + 2).cast("string"))))


def parts(count: int = PARTS) -> list[str]:
    """The plain letters of each part."""
    turn = [i % count if i // count % 2 == 0 else count - 1 - i % count for i in range(len(BY_FREQUENCY))]
    return ["".join(c for c, k in zip(BY_FREQUENCY, turn, strict=True) if k == part) for part in range(count)]


def signatures(letters: Column, count: int = PARTS) -> Column:
    """A hash for every choice of ``DISTANCE`` parts that are left out."""
    def part(c: Column) -> Column:
        plain = F.lit(None).cast("int")
        for k, own in enumerate(parts(count)):
            plain = F.when(F.instr(F.lit(own), c) > 0, k).otherwise(plain)
        return F.coalesce(plain, F.ascii(c) % count)

    def all_of(held: Column) -> Column:
        """``held``: the hash of each part."""
        chosen = [tuple(k for k in range(count) if k not in out) for out in combinations(range(count), DISTANCE)]
        return F.array(*[F.xxhash64(F.lit(n), *[F.get(held, F.lit(k)) for k in own]) for n, own in enumerate(chosen)])

    def hashes(dealt: Column) -> Column:
        return F.array(*[F.xxhash64(F.array_join(F.transform(F.filter(dealt, lambda x: x["part"] == k), lambda x: x["c"]), "")) for k in range(count)])

    dealt = F.transform(F.split(letters, ""), lambda c: F.struct(c.alias("c"), part(c).alias("part")))
    return let(dealt, lambda d: let(hashes(d), all_of))


def near_classes(words: DataFrame, count: int = PARTS) -> DataFrame:
    """Pairs (a, b) of classes of letters at a distance of 1 or 2 whose lengths differ by one at
    most, ``a`` the longer one (of equal lengths, the smaller), each once, with the letter that
    only ``a`` has (``less``) and the one that only ``b`` has (``more``, null if there is none)."""
    classes = words.select(letters_of(F.col("word")).alias("letters")).distinct()
    signed = classes.select("letters", F.explode(signatures(F.col("letters"), count)).alias("sign"))
    left, right = (signed.select("sign", F.col("letters").alias(side)) for side in ("a", "b"))
    longer = F.length("a") - F.length("b")
    met = left.join(right, "sign").filter((longer == 1) | ((longer == 0) & (F.col("a") < F.col("b")))).select("a", "b").distinct()
    va, vb = vector_of(F.col("a")), vector_of(F.col("b"))
    apart = met.withColumn("only", let(va, lambda a: let(vb, lambda b: F.struct(F.array_except(a, b).alias("a"), F.array_except(b, a).alias("b")))))
    # With lengths this close, distances 1 and 2 are these: one entry of a, and one or none of b.
    close = apart.filter((F.size("only.a") == 1) & (F.size("only.b") <= 1))
    letter = lambda side: F.substring(F.get(F.col(f"only.{side}"), F.lit(0)), 1, 1)
    return close.select("a", "b", letter("a").alias("less"), letter("b").alias("more"))


def _without(word: Column, letter: Column, keep_place: Column) -> Column:
    """What is left of the word without one ``letter``, for each place of it; with the place if
    ``keep_place``, else each text once and place -1."""
    size = F.length(word)
    at = F.filter(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)) == letter)
    rest = F.transform(at, lambda i: F.struct(
        F.when(keep_place, i).otherwise(-1).alias("place"),
        F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, size)).alias("rest")))
    return F.array_distinct(rest)


def near_words(words: DataFrame, count: int = PARTS) -> DataFrame:
    """(word, n, near, near_n) for all near words, in both directions, each pair once a direction."""
    pairs = stored(near_classes(words, count))
    placed = words.withColumn("letters", letters_of(F.col("word")))
    replaced = F.col("more").isNotNull()

    def side(own: str, letter: str, left: Column) -> DataFrame:
        held = pairs.join(placed, F.col(own) == F.col("letters"))
        return held.select("a", "b", F.col("word").alias(f"{own}_word"), F.col("n").alias(f"{own}_n"), F.explode(left).alias("left"))

    whole = F.array(F.struct(F.lit(-1).alias("place"), F.col("word").alias("rest")))
    first = side("a", "less", _without(F.col("word"), F.col("less"), replaced))
    second = side("b", "more", F.when(replaced, _without(F.col("word"), F.col("more"), replaced)).otherwise(whole))
    met = first.join(second, ["a", "b", "left"])
    both = F.array(*[F.struct(F.col(f"{x}_word").alias("word"), F.col(f"{x}_n").alias("n"), F.col(f"{y}_word").alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")])
    return met.select(F.explode(both).alias("p")).select("p.*")


def follow(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word of the chain of forms. Each round doubles the
    links passed; the chain has no ring, since counts grow along it."""
    now = stored(links.select("word", F.col("form").alias("root")))
    for _ in range(DOUBLINGS):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(further, "root", "left_semi").isEmpty():
            break
        now = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return now


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", one_in: int = 199, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n. ``times`` must be 5 or more."""
    words = stored(word_counts(docs, doc_id, text, one_in, least))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    told = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    roots = follow(told.filter("form IS NOT NULL").select("word", "form"))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
