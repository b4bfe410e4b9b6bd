"""Ambiguity of options, plans and replies; votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import lexicon as lex
from lectern.functions import replies as R
from lectern.functions import text as T
from lectern.functions.text import ColumnLike, col


def _overlap(a: Column, b: Column) -> Column:
    a, b = T.split_words(F.lower(a)), T.split_words(F.lower(b))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def similar_pairs(options: ColumnLike, over: float = 0.7) -> Column:
    """``array<struct<i, j>>`` of options sharing more than ``over`` of their words."""
    return F.filter(
        T.pairs_within(
            col(options),
            lambda a, i, b, j: F.when(_overlap(a, b) > over, F.struct(i.alias("i"), j.alias("j"))),
        ),
        lambda x: x.isNotNull(),
    )


def option_risks(options: ColumnLike, correct_index: ColumnLike) -> Column:
    """Warnings: very similar options, vague answer, one action verb in three options."""
    options = col(options)
    answer = F.lower(F.coalesce(F.get(options, col(correct_index)), F.lit("")))
    similar = F.transform(
        similar_pairs(options),
        lambda p: F.concat(F.lit("options "), p["i"], F.lit(" and "), p["j"], F.lit(" are very similar")),
    )
    vague = F.lit(0)
    for word in lex.VAGUE_QUALIFIERS:
        vague = vague + T.matches(answer, rf"\b{word}\b").cast("int")
    verbs = F.filter(
        T.words_array(lex.OPTION_ACTION_VERBS),
        lambda v: F.size(F.filter(options, lambda o: F.lower(o).contains(v))) >= 3,
    )
    return F.concat(
        similar,
        T.array_of_issues(
            (vague >= 2, F.concat(F.lit("vague qualifiers in answer: "), vague)),
            (F.size(verbs) > 0, F.concat(F.lit("same actions in options: "), F.array_join(verbs, ", "))),
        ),
    )


def quick_verdict(items: DataFrame) -> DataFrame:
    """Verdict without replies: risk -> ambiguous 0.6, else clear 0.7."""
    risky = F.size("warnings") > 0
    return items.withColumn("warnings", option_risks("options", "correct_index")).select(
        "item_id",
        F.when(risky, "ambiguous").otherwise("clear").alias("status"),
        "correct_index",
        F.array_join("warnings", "; ").alias("reasoning"),
        F.when(risky, 0.6).otherwise(0.7).alias("confidence"),
    )


def two_pass_verdict(items: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Verdict from two reply tables ``(item_id, reply)``.

    A blind answer that differs and is then called defensible makes the item ambiguous.
    """
    one = first.select("item_id", R.read_as("reply", "selected_index int, confidence double, reasoning string").alias("one"), R.is_object("reply").alias("ok1"))
    two = second.select("item_id", R.read_as("reply", "is_defensible boolean, defense string").alias("two"), R.is_object("reply").alias("ok2"))
    joined = items.select("item_id", "correct_index").join(one, "item_id", "left").join(two, "item_id", "left")
    ok = F.coalesce("ok1", F.lit(False))
    picked = F.when(ok, F.col("one.selected_index"))
    confidence = F.when(ok, F.coalesce("one.confidence", F.lit(0.5))).otherwise(0.0)
    unclear = (
        picked.isNotNull() & (picked != F.col("correct_index"))
        & F.coalesce(F.col("ok2") & F.col("two.is_defensible"), F.lit(False))
    )
    return joined.select(
        "item_id",
        F.when(unclear, "ambiguous").otherwise("clear").alias("status"),
        picked.alias("selected_index"),
        F.when(unclear, F.array(F.col("correct_index"), picked)).otherwise(F.array("correct_index")).alias("defensible_options"),
        F.when(unclear, 1.0 - confidence).otherwise(confidence).alias("confidence"),
        F.when(unclear, F.coalesce("two.defense", F.lit(""))).otherwise(
            F.coalesce(F.when(ok, F.col("one.reasoning")), F.lit(""))
        ).alias("reasoning"),
    )


def all_options_verdict(items: DataFrame, replies: DataFrame) -> DataFrame:
    """Verdict from one reply per item listing which options can be defended."""
    schema = (
        "defensible_options array<struct<index int, is_defensible boolean>>,"
        " overall_clarity string, ambiguity_reason string"
    )
    joined = items.select("item_id", "correct_index").join(
        replies.select("item_id", R.read_as("reply", schema).alias("r"), R.is_object("reply").alias("ok")), "item_id", "left"
    )
    others = F.transform(
        F.filter(
            F.coalesce("r.defensible_options", F.expr("cast(array() as array<struct<index:int,is_defensible:boolean>>)")),
            lambda o: o["is_defensible"] & (o["index"] != F.col("correct_index")),
        ),
        lambda o: o["index"],
    )
    ok = F.coalesce("ok", F.lit(False))
    unclear = (F.size(others) > 0) | (F.coalesce("r.overall_clarity", F.lit("clear")) == "ambiguous")
    return joined.select(
        "item_id",
        F.when(~ok, "invalid").when(unclear, "ambiguous").otherwise("clear").alias("status"),
        F.when(ok, F.concat(F.array("correct_index"), others)).alias("defensible_options"),
        F.when(~ok, 0.0).when(unclear, 0.5).otherwise(0.9).alias("confidence"),
    )


def vote_consensus(votes: DataFrame, panel: int = 10, needed: int = 9) -> DataFrame:
    """``votes(item_id, option)`` -> counts, consensus (smallest option on a tie), confidence."""
    counts = votes.groupBy("item_id", "option").agg(F.count(F.lit(1)).alias("votes"))
    return counts.groupBy("item_id").agg(
        F.sum("votes").alias("total_votes"),
        F.max("votes").alias("top_votes"),
        F.min_by("option", F.struct(-F.col("votes"), F.col("option"))).alias("consensus"),
    ).withColumn("confidence", F.col("top_votes") / F.lit(float(panel))).withColumn(
        "passes", F.col("top_votes") >= needed
    )


def vote_share(votes: DataFrame, share: float = 0.9) -> DataFrame:
    """Consensus for panels of any size: the top option holds at least ``share`` of the votes."""
    out = vote_consensus(votes).drop("confidence", "passes")
    top = F.col("top_votes") / F.col("total_votes")
    return out.withColumn("confidence", top).withColumn("passes", top >= share)


# --- plan against stem -------------------------------------------------------------------


def _lock_words(text: Column) -> Column:
    return F.array_except(T.long_words(text), T.words_array(lex.LOCK_STOP_WORDS))


def lock_issues(kind: ColumnLike, locks: ColumnLike, stem: ColumnLike) -> Column:
    """Lock types whose terms are under 40 % in the stem; only kinds that need a lock."""
    locks, stem_words = col(locks), T.long_words(stem)

    def uncovered(lock: Column) -> Column:
        words = _lock_words(lock["constraint_text"])
        share = F.size(F.array_intersect(words, stem_words)) / F.size(words)
        return F.when(F.size(words) < 2, F.lit(False)).otherwise(share < 0.4)

    weak = F.transform(F.filter(locks, uncovered), lambda x: x["lock_type"])
    return (
        F.when(~col(kind).isin(list(lex.LOCKED_QUESTION_TYPES)), T.words_array([]))
        .when(F.size(locks) == 0, T.words_array(["no_locks"]))
        .otherwise(weak)
    )


def repeated(values: ColumnLike) -> Column:
    """Distinct values that occur more than once, in first-seen order."""
    values = col(values)
    return F.filter(
        F.array_distinct(values), lambda v: F.size(F.filter(values, lambda x: x == v)) > 1
    )


def differentiation_issues(distractors: ColumnLike) -> Column:
    """Shared failure reasons, and violated facts under ten characters."""
    distractors = col(distractors)
    reasons = repeated(F.transform(distractors, lambda d: d["failure_reason"]))
    vague = F.transform(
        F.filter(
            F.transform(distractors, lambda d, i: F.struct(i.alias("i"), F.coalesce(d["stem_fact_violated"], F.lit("")).alias("f"))),
            lambda x: F.length(x["f"]) < 10,
        ),
        lambda x: F.concat(F.lit("vague_fact_"), x["i"] + 1),
    )
    shared = T.array_of_issues((F.size(reasons) > 0, F.concat(F.lit("shared_reason: "), F.array_join(reasons, ", "))))
    return F.when(F.size(distractors) < 2, T.words_array([])).otherwise(F.concat(shared, vague))


def factor_issues(factor: ColumnLike, stem: ColumnLike) -> Column:
    factor = F.coalesce(col(factor), F.lit(""))
    low = F.lower(factor)
    words = F.array_except(T.long_words(low), T.words_array(lex.FACTOR_STOP_WORDS))
    share = F.size(F.array_intersect(words, T.long_words(stem))) / F.size(words)
    vague = F.filter(T.words_array(lex.FACTOR_VAGUE_PHRASES), lambda p: low.contains(p))
    absent = T.array_of_issues(((F.size(words) >= 2) & (share < 0.3), "terms_not_in_stem"))
    return F.when(factor == "", T.words_array(["no_factor"])).otherwise(F.concat(vague, absent))


def strict_verdict(plans: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """All plan checks plus votes (``vote_consensus`` rows) when given."""
    checked = plans.select(
        "item_id",
        lock_issues("question_type", "decision_locks", "stem").alias("lock_issues"),
        differentiation_issues("distractors").alias("distractor_issues"),
        factor_issues("discriminating_factor", "stem").alias("factor_issues"),
    )
    if votes is None:
        checked = checked.withColumn("passes", F.lit(None).cast("boolean")).withColumn("confidence", F.lit(None).cast("double"))
    else:
        checked = checked.join(votes.select("item_id", "passes", "confidence"), "item_id", "left")
    count = F.size("lock_issues") + F.size("distractor_issues") + F.size("factor_issues")
    structural = F.when(count == 0, F.lit(0.8)).otherwise(F.greatest(F.lit(0.3), 1.0 - count * 0.2))
    return checked.select(
        "item_id", "lock_issues", "distractor_issues", "factor_issues",
        ((count == 0) & F.coalesce("passes", F.lit(True))).alias("passes"),
        F.coalesce("confidence", structural).alias("confidence"),
        F.array_join(
            T.array_of_issues(
                (F.size("lock_issues") > 0, "missing decision locks in stem"),
                (F.size("distractor_issues") > 0, "distractors not differentiated"),
                (F.size("factor_issues") > 0, "discriminating factor not explicit"),
                (~F.coalesce("passes", F.lit(True)), "votes are split"),
            ),
            ", ",
        ).alias("risks"),
    )
