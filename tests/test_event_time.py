"""Streams that give the batch result for any cut into batches, run counts taken in one pass, and the file inventory."""

import os
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lectern.operators import hierarchy, metrics
from lectern.operators.learner import mastery
from lectern.operators.novelty import greedy_dedup
from lectern.sources import readers
from lectern.streaming import jobs, state
from tests.test_operators import concept_rows
from tests.test_sources_and_streams import drain

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def batches(spark, rows, schema, path, cuts):
    """One file for each batch, read in order of their time."""
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{path}/{n}")
        for f in os.listdir(f"{path}/{n}"):
            os.utime(f"{path}/{n}/{f}", (1000 + n, 1000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


@pytest.mark.parametrize("cuts", [[], [20, 21, 60]])
def test_mastery_by_event_time(spark, tmp_path, cuts):
    rng = random.Random(3)
    base, rows = 1_700_000_000, []
    for n in range(120):  # up to 50 s out of order, with ties of time
        rows.append((rng.randrange(3), 1, n, base + n // 4 * 10 - rng.randrange(0, 50, 10), rng.random() < 0.9, rng.randrange(3, 6)))
    rows.append((99, 9, 10_000, base + 100_000, True, 5))  # moves the watermark past the others
    schema = "learner_id long, item_id long, event_id long, s long, is_correct boolean, confidence int"
    df = spark.createDataFrame(rows[:-1], schema).withColumn("ts", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = batches(spark, rows, schema, str(tmp_path / "in"), cuts).withColumn("ts", F.timestamp_seconds("s"))
        out = drain(state.ordered_mastery(stream, "200 seconds"), "update", f"ordered_{len(cuts)}", tmp_path).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {}
    for r in out:
        if r.reviews >= last.get(r.learner_id, r).reviews:
            last[r.learner_id] = r
    want = mastery(df, order=["ts", "event_id"]).collect()
    shape = lambda r: (r.learner_id, r.reviews, round(r.strength, 9), r.streak, r.last_confidence, r.is_mastered)
    assert sorted(map(shape, last.values())) == sorted(map(shape, want))


@pytest.mark.parametrize("cuts", [[], [1, 14]])
def test_novelty_across_batches(spark, tmp_path, cuts):
    rows = [("cap" if i % 5 else None, *r) for i, r in enumerate(concept_rows(9, 30))]
    schema = "capsule_id string, pos int, item_id string, concept_tag string, learning_target string"
    stream = batches(spark, rows, schema, str(tmp_path / "in"), cuts)
    out = str(tmp_path / "out")
    for n in range(2 if cuts else 1):  # a second start finds nothing new
        query = jobs.write_novelty(stream, str(tmp_path / "registry"), out, str(tmp_path / "ck"))
        assert query.awaitTermination(200) and query.exception() is None
    got = {r.item_id: not r.is_novel for r in spark.read.parquet(out).collect()}
    whole = spark.createDataFrame(rows, schema).withColumn("scope", F.coalesce("capsule_id", F.lit("none")))
    assert got == {r.item_id: r.is_duplicate for r in greedy_dedup(whole, scope=["scope"]).collect()}
    assert any(got.values()) and not all(got.values())


def test_stage_counts_in_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def judged(n):
        seen.add(1)
        return None if n % 7 == 0 else n % 2 == 0

    rows = spark.range(100).select("id", judged.asNondeterministic()("id").alias("success"), F.when(F.col("id") < 30, "a").when(F.col("id") < 35, "z").alias("kind"))
    observation = Observation()
    metrics.observe_stage(rows, observation, kind="kind", kinds=["a", "b"]).write.parquet(str(tmp_path / "out"))
    assert observation.get == {"total": 100, "succeeded": 42, "failed": 58, "a": 30, "b": 0, "other": 70}
    assert seen.value == 100  # nothing was worked out a second time
    empty = Observation()
    metrics.observe_stage(rows.limit(0), empty).collect()
    assert empty.get == {"total": 0, "succeeded": 0, "failed": 0}


def test_stage_counts_of_a_stream(spark, tmp_path):
    schema = "id long, success boolean"
    stream = batches(spark, [(i, i % 3 == 0) for i in range(30)], schema, str(tmp_path / "in"), [10, 11])
    query = (
        metrics.observe_stage(stream, "stage").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    assert query.awaitTermination(60)
    assert jobs.observed_counts(query, "stage") == {"total": 30, "succeeded": 10, "failed": 20}


def test_inventory_reads_the_first_bytes_only(spark, tmp_path):
    """A file of 3 GB (without blocks on disk) can't be read whole; a name with a space and a percent sign. Spark lists no empty files."""
    for name, head in (("huge.pdf", b"%PDF-"), ("sub dir/a %41.pdf", b"%PDF-"), ("other.pdf", b"GIF89a"), ("empty.pdf", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(head)
        if head:
            os.truncate(tmp_path / name, 3 << 30)
    got = {r.title: (r.length > 0, r.is_valid) for r in readers.pdf_files(spark, str(tmp_path)).collect()}
    assert got == {"huge": (True, True), "a %41": (True, True), "other": (True, False)}


def test_covered_ranges(spark):
    rows = [("c", i, f"n{i}") for i in range(50)] + [("d", 0, "x")]
    df = spark.createDataFrame(rows, "course string, at int, name string")
    ranges = hierarchy.covered_ranges(df, ["course"], ["at"])
    assert sorted((r.course, r.at, r.covered_end) for r in ranges.collect()) == sorted((c, i, i) for c, i, _ in rows)
    asked = ranges.filter("at = 3")
    got = hierarchy.names_before(asked, ranges, ["course"], "name").orderBy("place").collect()
    before = {r.at: r.already_covered for r in hierarchy.covered_before(df.filter("course = 'c'"), ["course"], "at", "name").collect()}
    assert [r.name for r in got] == before[3] == ["n0", "n1", "n2"]
