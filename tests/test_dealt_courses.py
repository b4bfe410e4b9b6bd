"""Texts are dealt by document before they unfold; what is made of a course is told apart where it lies."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.operators import corrections as C
from lectern.operators import hierarchy as H
from tests.test_corrections import tables

DEALT = ["corrected_course", "corrections_all_levels", "apply_corrections", "course_status", "correction_outcome", "capsule_put_back"]


@pytest.mark.parametrize("name", DEALT)
def test_nothing_but_texts_and_sums_is_moved(spark, sf, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert sum("hashpartitioning(doc_id" in line for line in moved) >= 1
    assert not [line for line in moved if any(c in line for c in ("entity_path", "_hash", "action_id", "course_id#")) and "status" not in line], moved


def test_sides_meet_as_in_a_full_join(spark):
    left = spark.createDataFrame([(1, "a", 10), (1, "a", 11), (1, "b", 12), (None, "a", 13)], "k long, p string, x int")
    right = spark.createDataFrame([(1, "a", "r"), (2, "b", "s"), (None, "a", "t")], "k long, p string, y string")
    met = H.beside(left, right, ["k", "p"], F.sort_array(F.collect_list("_l")).alias("l"), F.collect_list("_r").alias("r"), left_value=F.col("x"), right=F.col("y"))
    got = {(r.k, r.p, tuple(r.l), tuple(r.r)) for r in met.collect()}
    assert got == {(1, "a", (10, 11), ("r",)), (1, "b", (12,), ()), (2, "b", (), ("s",)), (None, "a", (13,), ()), (None, "a", (), ("t",))}


def test_replies_of_an_action_or_of_a_table_do_the_same(spark):
    items, actions, replies = tables(spark)
    listed = replies.groupBy("action_id").agg(F.collect_list(F.struct("attempt", "reply")).alias("tries"))
    beside = actions.join(listed.select("action_id", F.filter("tries", lambda t: t["attempt"] <= 2).alias("tries")), "action_id", "left")
    keyed = replies.withColumn("course_id", F.lit(1).cast("long"))
    rows = lambda parts: [sorted(map(str, part.collect())) for part in parts]
    want = rows(C.apply_queue(items, actions, replies))
    assert rows(C.apply_queue(items, beside.select(*actions.columns, "tries"), None)) == want
    assert rows(C.apply_queue(items, actions, keyed)) == want
