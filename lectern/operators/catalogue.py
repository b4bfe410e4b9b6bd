"""Matching wanted books with catalogue hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_books(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """Best hit per wanted book: the first whose author contains the wanted author, else the
    first; books without any hit have ``found`` false.

    ``wanted(book_id, title, author)``, ``hits(title, hit_pos, hit_id, hit_author)``. The best
    of each (title, author) pair is one mergeable minimum, worked out once however many books
    ask for it. Only the first hit of each author of a title can be the best, so a title's copies
    are gone before the authors asked for meet them.
    """
    each = hits.groupBy("title", "hit_author").agg(F.min_by(F.struct("hit_id", "hit_pos"), "hit_pos").alias("_hit"))
    first = each.select("title", "hit_author", "_hit.*")
    asked = wanted.select("title", F.coalesce("author", F.lit("")).alias("author")).distinct()
    fits = (F.col("author") != "") & F.coalesce(F.lower("hit_author"), F.lit("")).contains(F.lower("author"))
    best = (
        asked.join(first, "title")
        .groupBy("title", "author")
        .agg(F.min_by(F.struct("hit_id", "hit_author", "hit_pos"), F.struct((~fits).cast("int"), F.col("hit_pos"))).alias("hit"))
    )
    keyed = wanted.withColumn("_author", F.coalesce("author", F.lit("")))
    return (
        keyed.join(best.withColumnRenamed("author", "_author"), ["title", "_author"], "left")
        .withColumn("found", F.col("hit").isNotNull())
        .select("book_id", "title", "author", "hit.hit_id", "hit.hit_author", "found")
    )


def not_found(matched: DataFrame) -> DataFrame:
    return matched.filter(~F.col("found"))
