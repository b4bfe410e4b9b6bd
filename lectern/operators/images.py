"""Image descriptions and the best images of an item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.durable import first_by

NO_DESCRIPTION = "No description"


def describe_images(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Add ``description`` to ``images(path, ..)`` from ``annotations(annotation_pos, path, description)``.

    Exact path, then without ``images/``, then the first annotation path that ends with the
    file name. The suffix search is an equi-join: every annotation offers its trailing pieces
    that end a file name, i.e. the suffixes of its last path part, and longer names match whole.
    """
    known = first_by(["path"], F.struct(-F.col("annotation_pos")), annotations.filter(F.coalesce("description", F.lit("")) != ""))
    exact = known.select("path", F.col("description").alias("_exact"))
    short = known.select(F.col("path").alias("_short"), F.col("description").alias("_stripped"))
    last = F.element_at(F.split("path", "/"), -1)
    # a file name holds no slash, so it can only end inside the annotation's last part
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.length(last), F.lit(1))), lambda i: F.substring(last, i, F.length(last)))
    by_tail = (
        known.select("annotation_pos", "description", F.explode(F.array_distinct(tails)).alias("_name"))
        .groupBy("_name").agg(F.min_by("description", "annotation_pos").alias("_tail"))
    )
    distinct = images.select("path").distinct().withColumn("_name", last).withColumn(
        "_short", F.when(F.col("path").startswith("images/"), F.substring("path", 8, 10**6))
    )
    found = (
        distinct.join(exact, "path", "left").join(short, "_short", "left").join(by_tail, "_name", "left")
    )
    described = found.select(
        "path", F.coalesce("_exact", "_stripped", "_tail", F.lit(NO_DESCRIPTION)).alias("description")
    )
    return images.join(described, "path", "left")


def best_images(chunks: DataFrame, items: DataFrame, annotations: DataFrame | None = None, most: int = 3) -> DataFrame:
    """The top images per item, first occurrence of each path.

    ``chunks(item_id, chunk_pos, distance, image_paths)``, ``items(item_id, learning_target)``.
    Without annotations the chunk distance ranks; with them, word overlap with the target wins
    and the distance only breaks ties; an image without description keeps its distance.
    """
    seen = chunks.select(
        "item_id", "chunk_pos", F.coalesce("distance", F.lit(1.0)).alias("distance"),
        F.posexplode("image_paths").alias("image_pos", "path"),
    )
    first = first_by(["item_id", "path"], F.struct("chunk_pos", "image_pos"), seen)
    if annotations is None:
        scored = first.withColumn("score", F.col("distance"))
    else:
        described = describe_images(first, annotations).join(items.select("item_id", "learning_target"), "item_id")
        overlap = F.size(F.array_intersect(
            T.split_words(F.lower("learning_target")), T.split_words(F.lower("description"))
        ))
        plain = (F.col("description") == NO_DESCRIPTION) | (F.coalesce("learning_target", F.lit("")) == "")
        scored = described.withColumn(
            "score", F.when(plain, F.col("distance")).otherwise(F.col("distance") * 0.1 - overlap)
        )
    order = Window.partitionBy("item_id").orderBy("score", "chunk_pos", "image_pos")
    ranked = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return ranked.select("item_id", "place", "path", "score")
