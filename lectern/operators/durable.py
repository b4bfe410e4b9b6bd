"""Cutting lineage safely, and numbering rows without one big task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The copy survives lost executors, and every later use sees the same rows.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`durable` for wide rows: compressed columns in the shared folder, read as far as they are needed."""
    spark = df.sparkSession
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """0-based position of each row in its group, exact, with no group in a single task.

    Rows are range-partitioned by (group, order), so a hot group spreads over many tasks.
    Each range numbers its own rows; the ranges' row counts (one skinny row per group and
    range) give the offsets.
    """
    group, order = list(group), list(order)
    ranged = durable(
        df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    )
    local = Window.partitionBy(*group, "_range").orderBy(*order)
    before = (
        Window.partitionBy(*group)
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*group, "_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    return (
        ranged.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [*group, "_range"])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_range", "_local", "_offset")
    )


def first_by(key: Sequence[str], order: Column | str, df: DataFrame) -> DataFrame:
    """The first row per key by ``order``; a mergeable aggregate, so hot keys shrink early."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*key, *[F.col("_row")[c].alias(c) for c in rest])
