"""Connected components of a table of links, by alternating large and small stars.

Links never leave the executors; every round is two aggregations and two joins over links only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    moved = joined.select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(joined.select(F.col("m").alias("a"), "b")).filter("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) into (node, component): every linked node but the least of its component,
    with that least one. Loops, repeats and either direction are fine; no links, no rows."""
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or now == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        mark = now
        edges = stored(_small_star(_large_star(edges)))
