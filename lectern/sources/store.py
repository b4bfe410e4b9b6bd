"""Sinks: collections, snapshots, reports and queues as partitioned files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import lexicon as lex
from lectern.functions.naming import snapshot_name
from lectern.operators.corrections import queue_counts
from lectern.operators.durable import durable, first_by
from lectern.sources.versioned import VersionedTable


def _overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _collections(spark: SparkSession, path: str, key: str) -> VersionedTable:
    return VersionedTable(spark, path, ["collection", key])


def collections(spark: SparkSession, path: str, version: int | None = None, key: str = "chunk_id") -> DataFrame:
    """All chunks of the latest or an earlier version."""
    return _collections(spark, path, key).read(version)


def upsert_collections(chunks: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Replace or add chunks by (collection, chunk id) in one new version.

    The new rows, which may hold an embedding step, are worked out once; only the buckets that they
    fall into are read and written.
    """
    _collections(chunks.sparkSession, path, key).upsert(chunks)


def rebuild_collections(chunks: DataFrame, path: str, planned: DataFrame | None = None, key: str = "chunk_id") -> None:
    """Drop the planned collections and write them anew in one new version; all others stay.

    ``planned`` (collection) names those that go even if no chunk arrives for them.
    """
    chunks = durable(chunks)
    gone = chunks.select("collection")
    if planned is not None:
        gone = gone.union(planned.select("collection"))
    _collections(chunks.sparkSession, path, key).replace(chunks, gone.distinct())


def save_snapshot(courses: DataFrame, stage: str, path: str, engine: str | None = None, model: str | None = None) -> None:
    """Stage snapshot under certification, version and stage; a rerun replaces its own."""
    if stage not in lex.STAGES:
        raise ValueError(f"unknown stage {stage!r}, expected one of {lex.STAGES}")
    stamped = (
        courses.withColumn("checkpoint_stage", F.lit(stage)).withColumn("checkpoint_engine", F.lit(engine).cast("string"))
        .withColumn("checkpoint_model", F.lit(model).cast("string")).withColumn("saved_at", F.current_timestamp())
        .withColumn("certification", snapshot_name("certification_name")).withColumn("snapshot_version", F.col("version"))
        .withColumn("stage", F.lit(stage))
    )
    _overwrite_partitions(stamped, path, ["certification", "snapshot_version", "stage"])


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Stored snapshots, newest first; unreadable files are skipped."""
    rows = spark.read.option("ignoreCorruptFiles", True).parquet(path)
    return (
        rows.groupBy("certification", "snapshot_version", "stage")
        .agg(F.max("saved_at").alias("saved_at"), F.max("checkpoint_engine").alias("engine"), F.max("checkpoint_model").alias("model"), F.count(F.lit(1)).alias("courses"))
        .orderBy(F.desc("saved_at"), "certification", "snapshot_version", "stage")
    )


def stage_ordinal(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in lex.STAGES]), stage).cast("int") - 1


def stages_between(after: str | None = None, until: str | None = None) -> list[str]:
    """Stages after the resume point, up to the stop point."""
    for stage in (after, until):
        if stage is not None and stage not in lex.STAGES:
            raise ValueError(f"unknown stage {stage!r}")
    first = 0 if after is None else lex.STAGES.index(after) + 1
    last = len(lex.STAGES) if until is None else lex.STAGES.index(until) + 1
    return list(lex.STAGES[first:last])


def write_version(courses: DataFrame, path: str, key: str = "course_id") -> None:
    """Results under ``versions`` by course and version, and a copy of each course's newest one under
    ``latest``. Either table changes in one step; the copy follows the results, so after a kill between
    the two a rerun brings it up to date."""
    spark = courses.sparkSession
    courses = durable(courses)
    VersionedTable(spark, f"{path}/versions", [key, "version"]).upsert(courses)
    newest = first_by([key], F.struct(-F.col("version"), F.to_json(F.struct("*"))), courses).select(*courses.columns)
    copy = VersionedTable(spark, f"{path}/latest", [key])
    if copy.manifest():
        newer = copy.read().select(F.col(key).alias("_key"), F.col("version").alias("_version"))
        newest = newest.join(newer, newest[key].eqNullSafe(newer["_key"]) & (newer["_version"] > newest["version"]), "left_anti")
    copy.upsert(newest)


def latest(spark: SparkSession, path: str, key: str = "course_id") -> DataFrame:
    """The newest version of each course, from its copy."""
    return VersionedTable(spark, f"{path}/latest", [key]).read()


def version_of(spark: SparkSession, path: str, version: int, key: str = "course_id") -> DataFrame:
    return VersionedTable(spark, f"{path}/versions", [key, "version"]).read().filter(F.col("version") == version)


def write_report(results: DataFrame, counts: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(f"{path}/results")
    counts.write.mode("overwrite").json(f"{path}/counts")


def queue_lines(actions: DataFrame, headers: DataFrame) -> DataFrame:
    """JSON lines of queues: the header line first, then actions by urgency."""
    head = headers.select(
        "certification_name", F.lit(10**9).alias("_urgency"), F.lit("").alias("_id"),
        F.to_json(F.struct(F.lit("queue_header").alias("_type"), "certification_name", "source_version", "target_version", "created_at")).alias("value"),
    )
    own = [c for c in actions.columns if c != "certification_name"]
    body = actions.select("certification_name", F.col("priority").alias("_urgency"), F.col("action_id").alias("_id"), F.to_json(F.struct(*own)).alias("value"))
    return head.unionByName(body)


def write_queue(actions: DataFrame, headers: DataFrame, path: str) -> None:
    """One folder of ordered part files per certification: a range sort, never one big task.

    Only the folders of the given certifications are replaced. Rows are sorted by folder first,
    which is the order that the writer asks for, so it keeps the order within.
    """
    order = ["certification", "certification_name", F.desc("_urgency"), "_id"]
    lines = queue_lines(actions, headers).withColumn("certification", snapshot_name("certification_name"))
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value", "certification")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("certification").text(path)


def append_actions(actions: DataFrame, path: str) -> None:
    """Add actions to a written queue as further part files."""
    own = [c for c in actions.columns if c != "certification_name"]
    lines = actions.select(F.to_json(F.struct(*own)).alias("value"), snapshot_name("certification_name").alias("certification"))
    lines.write.mode("append").partitionBy("certification").text(path)


def queue_state(actions: DataFrame, version: int, validated_at: Column) -> DataFrame:
    """State row per certification."""
    return queue_counts(actions, ["certification_name"]).select(
        "certification_name", F.lit(version).alias("current_version"), validated_at.alias("last_validation"),
        F.col("pending_count").alias("pending_corrections"), F.col("applied_count").alias("applied_corrections"),
    )
