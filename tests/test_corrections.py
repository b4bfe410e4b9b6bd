"""The queue is applied on one row per entity: few shuffles, each reply read once, the same outcome."""

import json

from pyspark.sql import functions as F

from lectern.operators import corrections as C

ITEM = "course_id long, entity_path array<string>, content string, options array<string>, correct_answer_index int, explanation string, difficulty string"
ACTION = "course_id long, action_id string, entity_type string, entity_path array<string>, action_type string, priority int, field_corrections map<string,string>, status string"


def tables(spark):
    whole = json.dumps({"stem": "What is the new question?", "options": ["a", "b", "c", "d"], "correct_index": 1})
    items = [(1, ["m", f"item_{n}"], f"Content of item {n}", ["a", "b"], 0, "Because of it.", "easy") for n in range(4)]
    actions = [
        (1, "a0", "item", ["m", "item_0"], "auto_fix", 10, {"difficulty": "hard"}, "pending"),
        (1, "a1", "item", ["m", "item_0"], "auto_fix", 50, {"difficulty": "medium"}, "pending"),
        (1, "a2", "item", ["m", "item_1"], "regenerate", 50, {}, "pending"),
        (1, "a3", "item", ["m", "item_2"], "regenerate", 50, {}, "pending"),
        (1, "a4", "item", ["m", "gone"], "regenerate", 50, {}, "pending"),
        (1, "a5", "lab", ["m", "lab_0"], "regenerate", 50, {}, "pending"),
        (1, "a6", "item", ["m", "item_3"], "manual_review", 100, {}, "pending"),
        (1, "a7", "item", ["m", "item_3"], "auto_fix", 10, {"nope": "x"}, "pending"),
        (1, "a8", "item", ["m", "item_3"], "auto_fix", 10, {"content": "x"}, "done"),
    ]
    replies = [("a2", 1, '{"stem": "cut'), ("a2", 2, f"```json\n{whole}\n```"), ("a3", 1, '{"stem": "short"}'), ("a3", 2, "no"), ("a3", 3, whole), ("a4", 1, whole)]
    return spark.createDataFrame(items, ITEM), spark.createDataFrame(actions, ACTION), spark.createDataFrame(replies, "action_id string, attempt int, reply string")


def test_apply_queue(spark):
    items, outcome = C.apply_queue(*tables(spark))
    got = {r.entity_path[-1]: r for r in items.collect()}
    assert items.columns == tables(spark)[0].columns and len(got) == 4
    assert got["item_0"].difficulty == "hard" and got["item_0"].content == "Content of item 0"
    assert (got["item_1"].content, len(got["item_1"].options), got["item_1"].correct_answer_index, got["item_1"].explanation) == ("What is the new question?", 4, 1, "Because of it.")
    assert got["item_2"].content == "Content of item 2" and got["item_3"].content == "Content of item 3"
    assert {r.action_id: (r.status, r.error) for r in outcome.collect()} == {
        "a0": ("applied", None), "a1": ("applied", None), "a2": ("applied", None), "a3": ("failed", "no valid reply in 2 attempts"),
        "a4": ("failed", "entity not found"), "a5": ("skipped", None), "a6": ("skipped", "Manual review required"), "a7": ("failed", "entity or field not found"),
    }


def test_failed_reply_may_overwrite(spark):
    items, _ = C.apply_queue(*tables(spark), overwrite_on_failure=True)
    assert {r.entity_path[-1]: r.content for r in items.collect()}["item_2"] == "short"


def test_without_replies(spark):
    items, outcome = C.apply_queue(*tables(spark)[:2], None)
    assert {r.action_id: r.status for r in outcome.collect()} == {"a0": "applied", "a1": "applied", "a2": "skipped", "a3": "skipped", "a4": "skipped", "a5": "skipped", "a6": "skipped", "a7": "failed"}
    assert {r.content for r in items.collect()} == {f"Content of item {n}" for n in range(4)}


def test_few_shuffles(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, most in zip(C.apply_queue(*tables(spark)), (4, 5), strict=True):
            plan = df.groupBy().agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") <= most, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_review_items_checks_documents_once(spark, sf):
    """Both parts come from one pass; the returned frame reads their counts, no documents."""
    import __spark_entry__ as entry

    plan = entry.queries()["review_items"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "documents" not in plan
