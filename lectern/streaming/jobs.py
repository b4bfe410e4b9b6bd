"""Streaming jobs: incremental collections, de-duplication, sessions, pass rates, metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions import text as T
from lectern.operators.chunking import chunk_books, stable_chunk_ids
from lectern.operators.durable import durable
from lectern.operators.learner import finish_sessions, session_measures
from lectern.operators.metrics import measures, ratio
from lectern.operators.novelty import greedy_dedup
from lectern.sources.store import upsert_collections
from lectern.sources.versioned import VersionedTable

BOOK_ROWS = (
    "book_id string, collection string, markdown string, blocks array<struct<text:string,page_idx:int>>,"
    " book_title string, book_author string, source_file string"
)


def load_collections(
    spark: SparkSession, books_path: str, store_path: str, checkpoint: str,
    add_vectors: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    """New book rows (JSON files) -> chunks -> upsert; ids come from the chunk's origin, so a
    replayed batch writes the same rows."""
    books = spark.readStream.schema(BOOK_ROWS).json(books_path)

    def store(batch: DataFrame, _: int) -> None:
        chunks = chunk_books(batch, "book_id", ("collection", "book_title", "book_author", "source_file"))
        upsert_collections(add_vectors(stable_chunk_ids(chunks)), store_path)

    return books.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_quotes_stream(quotes: DataFrame, lateness: str = "1 hour", key: Sequence[str] = ("item_id",)) -> DataFrame:
    """First occurrence of each quote text per item inside the watermark."""
    return (
        quotes.withColumn("_text", T.strip(F.lower("sentence"))).withWatermark("ts", lateness)
        .dropDuplicatesWithinWatermark([*key, "_text"]).drop("_text")
    )


def sessions_stream(reviews: DataFrame, gap: str, lateness: str = "1 hour", key: str = "learner_id") -> DataFrame:
    """Review sessions per learner, emitted when the watermark has passed them."""
    sessions = (
        reviews.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), key).agg(*session_measures())
    )
    return finish_sessions(sessions).select(key, F.col("w.start").alias("session_start"), "items", "correct", "total_time", "accuracy_rate", "average_confidence")


def pass_rates(scores: DataFrame, window: str = "1 hour", slide: str | None = None, least: int = 70, lateness: str | None = None) -> DataFrame:
    """Share of attempts at or over ``least`` per (sliding) window; batch or stream."""
    rows = scores.withWatermark("ts", lateness) if lateness else scores
    spans = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = rows.groupBy(spans.alias("w")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("score") >= least).alias("passed"))
    return out.select(
        F.col("w.start").alias("window_start"), "attempts", "passed", ratio("passed", "attempts").alias("pass_rate")
    )


def rolling_metrics(records: DataFrame) -> DataFrame:
    """Quality counts per capsule, kept up to date in update mode."""
    return records.groupBy("capsule_id").agg(*measures())


def mark_late(batch: DataFrame, lateness_seconds: int, order: Sequence[str] = (), newest_before: int | None = None) -> DataFrame:
    """``is_late``: is a row older than the newest event known by more than the allowed lateness?

    ``order`` names columns that give each row its own place of arrival (an offset): a row is then
    compared with earlier arrivals only. Without it, it is compared with its whole batch.
    ``newest_before``: newest event of earlier batches in microseconds. Rows without ``ts`` are on time.
    """
    known = F.timestamp_micros(F.lit(newest_before).cast("long"))
    allowed = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lateness_seconds))
    if order:
        # ranges of arrivals: a running maximum in each, and one row per range for those before it
        ranged = durable(batch.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
        earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        tops = ranged.groupBy("_range").agg(F.max("ts").alias("_top")).select("_range", F.max("_top").over(earlier).alias("_before"))
        inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = ranged.join(F.broadcast(tops), "_range").withColumn("_newest", F.greatest("_before", F.max("ts").over(inside), known))
    else:
        rows = batch.join(F.broadcast(batch.agg(F.max("ts").alias("_top")))).withColumn("_newest", F.greatest("_top", known))
    late = F.coalesce(F.col("ts") < F.col("_newest") - allowed, F.lit(False))
    return rows.withColumn("is_late", late).select(*batch.columns, "is_late")


def write_with_late_rows(
    stream: DataFrame, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], checkpoint: str,
    lateness_seconds: int, order: Sequence[str] = (),
) -> StreamingQuery:
    """Split each batch into rows within the allowed lateness and rows for a side table.

    The newest event so far is kept beside the checkpoint in two slots in turn, by batch number: a
    batch that is run again finds what its predecessor left. With ``order`` (see :func:`mark_late`)
    the same rows are late however the stream is cut into batches.
    """
    slot = lambda number: f"{checkpoint.rstrip('/')}_newest/{number % 2}"

    def split(batch: DataFrame, number: int) -> None:
        spark, before = batch.sparkSession, None
        if number:
            left = spark.read.schema("newest long, number long").parquet(slot(number - 1)).first()
            if left is None or left.number != number - 1:
                raise ValueError(f"no newest event of batch {number - 1} beside {checkpoint}")
            before = left.newest
        batch = batch.persist()
        marked = mark_late(batch, lateness_seconds, order, before)
        on_time(marked.filter(~F.col("is_late")).drop("is_late"), number)
        late(marked.filter("is_late").drop("is_late"), number)
        newest = F.greatest(F.max(F.unix_micros("ts")), F.lit(before).cast("long"))
        batch.agg(newest.alias("newest")).withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(slot(number))
        batch.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_novelty(items: DataFrame, registry_path: str, out_path: str, checkpoint: str, threshold: float = 0.85) -> StreamingQuery:
    """Greedy novelty per capsule on a stream of ``(capsule_id, item_id, pos, concept_tag, learning_target)``.

    Kept concepts lie in a versioned table. A batch is judged after the kept concepts of the capsules it
    names, by the batch operator :func:`greedy_dedup`: its keys are (capsule, rare word), so a capsule with
    most of the rows is many tasks. Concepts are ordered by batch, then ``pos`` (unique in a capsule and batch),
    so batches cut in order of arrival give what one batch gives. Rows ``(capsule_id, item_id, is_novel,
    duplicate_of, similarity)`` go to ``out_path/batch=N``. A batch that is run again sees earlier batches'
    concepts only and writes the same rows. Null capsules form one capsule of their own.
    """
    columns = ["capsule_id", "item_id", "pos", "concept_tag", "learning_target"]

    def judge(batch: DataFrame, number: int) -> None:
        registry = VersionedTable(batch.sparkSession, registry_path, ["capsule_id", "batch", "pos"])
        place = F.lit(number).cast("long").alias("batch")
        rows = durable(batch.select(*columns).withColumns({"batch": place, "pos": F.col("pos").cast("long")}))
        pool = rows
        if registry.versions():
            named = rows.select("capsule_id").distinct().withColumnRenamed("capsule_id", "_named")
            earlier = registry.read().filter(F.col("batch") < number)
            pool = pool.unionByName(earlier.join(named, F.col("capsule_id").eqNullSafe(F.col("_named")), "left_semi"))
        # a null can't be a scope of the joins inside
        scoped = pool.select(F.struct(F.col("capsule_id").isNull().alias("none"), F.coalesce(F.col("capsule_id").cast("string"), F.lit("")).alias("id")).alias("scope"),
                             *columns[:2], F.struct("batch", "pos").alias("pos"), *columns[3:])
        judged = durable(greedy_dedup(scoped, threshold, scope=["scope"]).filter(F.col("pos.batch") == number))
        novel = ~F.col("is_duplicate")
        out = judged.select("capsule_id", "item_id", novel.alias("is_novel"), "duplicate_of", F.col("similarity_score").alias("similarity"))
        out.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={number}")
        registry.upsert(judged.filter(novel).select(*columns[:2], "pos.batch", "pos.pos", *columns[3:]))

    return items.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observed_counts(query: StreamingQuery, name: str) -> dict:
    """Totals of a measure set (see :func:`lectern.operators.metrics.observe_stage`) over a stream's batches that are still reported."""
    total: dict = {}
    for progress in query.recentProgress:
        seen = progress["observedMetrics"].get(name)
        for key, value in (seen.asDict() if hasattr(seen, "asDict") else seen or {}).items():
            total[key] = total.get(key, 0) + (value or 0)
    return total
