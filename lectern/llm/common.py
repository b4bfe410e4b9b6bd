"""Helpers shared by the corpus operators: words, one-time bindings, tables written once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is worked out once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of characters other than space, tab and line ends; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def positions(size: Column) -> Column:
    """0 .. size - 1; empty where size <= 0 (``sequence`` would count down)."""
    return F.when(size > 0, F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder of the cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: it cuts the lineage, survives
    lost executors, and is smaller than a checkpoint."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows of a batch that goes to Python, for what is run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to this many ids (8 bytes each) are sent to every executor; more are shuffled with the rows.
BROADCAST_IDS = 2_000_000


def sent_if_few(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """``ids``, written once, marked for broadcast if they have been counted and are few."""
    ids = stored(ids)
    return F.broadcast(ids) if ids.count() <= bound else ids


def without(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in the only column of ``ids``; null ids stay."""
    gone = sent_if_few(ids.toDF("_gone").filter("_gone IS NOT NULL").distinct())
    return docs.join(gone, F.col(doc_id) == F.col("_gone"), "left_anti")


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, stored with a long of its own for each row, and the name of that column. Ids may be
    null or repeat; what is decided by row must not go by them."""
    name = "_row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id())), name
