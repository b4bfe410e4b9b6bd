"""Repair routing after failed repair gates, and acceptance of repair replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import replies as R
from lectern.functions import text as T
from lectern.functions.text import ColumnLike, col
from lectern.operators.unnest import unnest

MAX_ATTEMPTS = 2
REPAIR_TYPE = {"distractor_quality": "distractors", "decision_grounding": "explanation"}


def can_repair(tier_1: ColumnLike = "tier_1_passed", tier_2: ColumnLike = "tier_2_passed") -> Column:
    return col(tier_1) & ~col(tier_2)


def route_repairs(gated: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per failed repair gate: a repair to request, or a remaining issue."""
    failed = unnest(gated, "checks", ["item_id"], "c", "check_pos").filter(
        (F.col("c.tier") == "tier_2_repair") & (F.col("c.result") == "fail")
    )
    kind = F.lit(None).cast("string")
    for gate, repair in REPAIR_TYPE.items():
        kind = F.when(F.col("c.gate_name") == gate, repair).otherwise(kind)
    order = Window.partitionBy("item_id", "repair_type").orderBy("check_pos")
    routed = failed.withColumn("repair_type", kind).withColumn("attempt", F.row_number().over(order))
    issue = (
        F.when(F.col("c.gate_name") == "difficulty_alignment", F.concat(F.lit("Difficulty mismatch: "), F.col("c.repair_hint")))
        .when(F.col("repair_type").isNull(), F.concat(F.lit("Unknown repair target: "), F.col("c.gate_name")))
        .when(F.col("attempt") > max_attempts, F.concat(F.lit("Max attempts reached for "), F.col("repair_type")))
    )
    return routed.select(
        "item_id", "check_pos", F.col("c.gate_name").alias("gate_name"),
        F.when(issue.isNull(), F.col("repair_type")).alias("repair_type"),
        F.when(issue.isNull(), F.col("attempt")).alias("attempt"),
        issue.alias("remaining_issue"),
    )


def explanation_accepted(text: ColumnLike, missing_ids: ColumnLike) -> Column:
    text = col(text)
    return F.forall(col(missing_ids), lambda q: text.contains(F.concat(F.lit("["), q, F.lit("]"))))


def stem_accepted(text: ColumnLike, answer: ColumnLike) -> Column:
    return ~F.lower(col(text)).contains(F.lower(col(answer)))


def distractor_reply(reply: ColumnLike) -> Column:
    """The replied list, null when the reply is no JSON list."""
    body = R.strip_fences(reply)
    return F.when(F.try_parse_json(body).isNotNull() & body.startswith("["), F.from_json(body, "array<string>"))


def distractors_accepted(new: ColumnLike, old: ColumnLike, answer: ColumnLike) -> Column:
    new, key = col(new), T.strip(F.lower(col(answer)))
    good = F.forall(new, lambda d: (F.length(T.strip(d)) >= 5) & (T.strip(F.lower(d)) != key))
    return F.coalesce(good & (F.size(new) == F.size(col(old))), F.lit(False))


def option_accepted(new: ColumnLike, old: ColumnLike, quote: ColumnLike) -> Column:
    new, quote = col(new), col(quote)
    return (
        (F.lower(new) != F.lower(col(old)))
        & ~F.lower(new).contains(F.lower(quote))
        & T.word_count(new).between(5, 20)
    )


def apply_repairs(items: DataFrame, routed: DataFrame, replies: DataFrame) -> DataFrame:
    """Final content and remaining issues per item.

    ``items(item_id, explanation, distractors, correct_answer, missing_quote_ids)``,
    ``replies(item_id, repair_type, attempt, reply)``. A failed reply keeps the old content.
    """
    asked = routed.filter(F.col("repair_type").isNotNull()).join(
        replies, ["item_id", "repair_type", "attempt"], "left"
    )
    judged = asked.join(
        items.select("item_id", "distractors", "correct_answer", "missing_quote_ids"), "item_id"
    ).withColumn("new_distractors", distractor_reply("reply"))
    is_text = F.col("repair_type") == "explanation"
    ok = F.coalesce(
        F.when(is_text, explanation_accepted(T.strip("reply"), "missing_quote_ids")).otherwise(
            distractors_accepted("new_distractors", "distractors", "correct_answer")
        ),
        F.lit(False),
    )
    issue = F.when(
        ~ok, F.concat(F.when(is_text, "Explanation").otherwise("Distractor"), F.lit(" repair failed"))
    )
    attempts = judged.withColumn("ok", ok).withColumn("issue", issue)
    # at most a handful of repair gates per item
    done = attempts.groupBy("item_id").agg(
        F.max_by(F.when(is_text & F.col("ok"), T.strip("reply")), F.struct(is_text & F.col("ok"), "check_pos")).alias("new_explanation"),
        F.max_by(F.when(~is_text & F.col("ok"), F.col("new_distractors")), F.struct(~is_text & F.col("ok"), "check_pos")).alias("new_distractors"),
        F.count(F.lit(1)).alias("repairs_attempted"),
    )
    issues = (
        routed.select("item_id", "check_pos", F.col("remaining_issue").alias("issue"))
        .unionByName(attempts.select("item_id", "check_pos", "issue"))
        .filter(F.col("issue").isNotNull())
        .groupBy("item_id")
        .agg(F.array_sort(F.collect_list(F.struct("check_pos", "issue"))).alias("i"))
        .select("item_id", F.transform("i", lambda x: x["issue"]).alias("remaining_issues"))
    )
    return (
        items.join(done, "item_id", "left")
        .join(issues, "item_id", "left")
        .withColumn("explanation", F.coalesce("new_explanation", "explanation"))
        .withColumn("distractors", F.coalesce("new_distractors", "distractors"))
        .withColumn("repairs_attempted", F.coalesce("repairs_attempted", F.lit(0)))
        .withColumn("remaining_issues", F.coalesce("remaining_issues", T.words_array([])))
        .withColumn("fully_repaired", F.size("remaining_issues") == 0)
        .drop("new_explanation", "new_distractors")
    )


def repair_summary(repaired: DataFrame) -> DataFrame:
    """Readable repair text per item."""
    status = F.when(F.col("fully_repaired"), "FULLY REPAIRED").otherwise("PARTIALLY REPAIRED")
    lines = F.concat(
        F.array(
            F.concat(F.lit("Repair of "), F.col("item_id").cast("string")),
            F.concat(F.lit("Status: "), status),
            F.concat(F.lit("Repairs attempted: "), F.col("repairs_attempted").cast("string")),
        ),
        F.transform("remaining_issues", lambda i: F.concat(F.lit("- "), i)),
    )
    return repaired.select("item_id", F.array_join(lines, "\n").alias("summary"))
