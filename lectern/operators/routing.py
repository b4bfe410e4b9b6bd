"""Which file goes to which collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.naming import collection_name
from lectern.functions.text import ColumnLike, col


def parse_mapping(value: ColumnLike) -> Column:
    """``folder:c1,c2`` -> ``struct<folder, collections>``; an entry without colon is an error."""
    value = col(value)
    checked = F.when(value.contains(":"), value).otherwise(
        F.raise_error(F.concat(F.lit("mapping needs folder:collection, got "), value))
    )
    names = F.transform(F.split(F.substring(checked, F.position(F.lit(":"), checked) + 1, F.length(checked)), ","), T.strip)
    return F.struct(T.strip(F.split_part(checked, F.lit(":"), F.lit(1))).alias("folder"), names.alias("collections"))


def top_folder(path: ColumnLike, root: str) -> Column:
    """First folder below the root; null for files right in the root."""
    rest = F.regexp_replace(col(path), "^(?:file:)?/*" + root.strip("/") + "/", "")
    return F.when(rest.contains("/"), F.split_part(rest, F.lit("/"), F.lit(1)))


def depth_below(path: ColumnLike, root: str) -> Column:
    """Folders between the root and the file."""
    rest = F.regexp_replace(col(path), "^(?:file:)?/*" + root.strip("/") + "/", "")
    return F.size(F.split(rest, "/")) - 1


def collection_plan(files: DataFrame, mapping: DataFrame | None = None, exact_depth: int | None = None) -> DataFrame:
    """Fan files out: a mapped folder to its collections, another to its sanitised name.

    ``files(folder, ..)`` with ``depth`` when ``exact_depth`` is used (1 = direct children
    only); ``mapping(folder, collections)``. Folders without files do not appear.
    """
    if exact_depth is not None:
        files = files.filter(F.col("depth") == exact_depth)
    own = F.array(collection_name("folder"))
    if mapping is None:
        routed = files.withColumn("_targets", own)
    else:
        routed = files.join(mapping.select("folder", F.col("collections").alias("_m")), "folder", "left").withColumn(
            "_targets", F.coalesce("_m", own)
        ).drop("_m")
    return routed.withColumn("collection", F.explode("_targets")).drop("_targets")


def plan_summary(plan: DataFrame) -> DataFrame:
    """Books per collection."""
    return plan.groupBy("collection").agg(F.count(F.lit(1)).alias("books"))


def distinct_files(plan: DataFrame, key: str = "path") -> DataFrame:
    """Each file once, however many collections want it."""
    return plan.drop("collection").dropDuplicates([key])


def fan_out(results: DataFrame, plan: DataFrame, key: str = "path") -> DataFrame:
    """Results of once-processed files to every collection that wants them."""
    return results.join(plan.select(key, "collection").distinct(), key)


def partition_books(books: DataFrame, extension: str = "extension") -> DataFrame:
    """Only PDFs can be extracted; others become failure rows in place."""
    is_pdf = F.lower(F.coalesce(extension, F.lit("pdf"))) == "pdf"
    return books.withColumn("success", is_pdf).withColumn(
        "error", F.when(~is_pdf, F.concat(F.lit("Unsupported format: "), F.col(extension)))
    )


def chunk_totals(chunks: DataFrame, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"))
