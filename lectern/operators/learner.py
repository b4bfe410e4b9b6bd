"""Answers, scores, review sessions and mastery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import ColumnLike, col
from lectern.operators.metrics import half_up, ratio

# fixed values
MASTERY_STRENGTH, MASTERY_STREAK, MASTERY_CONFIDENCE = 0.9, 3, 4
MAX_INTERVAL_DAYS, MAX_SESSION_ITEMS, DEFAULT_SESSION_ITEMS = 180, 50, 10


def capped_selection(selected: ColumnLike, correct_count: ColumnLike) -> Column:
    """The first selections up to the number of correct options."""
    return F.slice(col(selected), F.lit(1), F.greatest(F.coalesce(col(correct_count), F.lit(1)), F.lit(1)))


def answer_status(selected: ColumnLike, correct: ColumnLike, multiple: ColumnLike) -> Column:
    """unanswered, correct, partially_correct or incorrect, from option id arrays.

    A single-choice question only looks at the first correct option.
    """
    selected, correct = col(selected), col(correct)
    equal = (F.size(F.array_except(correct, selected)) == 0) & (F.size(F.array_except(selected, correct)) == 0)
    several = F.when(equal, "correct").when(F.arrays_overlap(selected, correct), "partially_correct").otherwise("incorrect")
    single = F.when((F.size(selected) == 1) & (F.get(selected, F.lit(0)) == F.get(correct, F.lit(0))), "correct").otherwise("incorrect")
    return F.when(selected.isNull() | (F.size(selected) == 0), "unanswered").when(col(multiple), several).otherwise(single)


def capsule_score(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score of answered questions ``(keys, status)``: 1 per correct, half per partial."""
    points = F.when(F.col("status") == "correct", 1.0).when(F.col("status") == "partially_correct", 0.5).otherwise(0.0)
    out = answers.groupBy(*keys).agg(
        F.sum(points).alias("points"), F.count_if(F.col("status") == "partially_correct").alias("partially_correct"),
        F.count(F.lit(1)).alias("total"),
    )
    return out.select(
        *keys, F.floor("points").alias("correct"), "partially_correct", "total",
        half_up(F.col("points") / F.col("total") * 100).alias("percentage"),
    )


def attempts(scores: DataFrame, times: DataFrame, keys: Sequence[str] = ("learner_id", "capsule_id")) -> DataFrame:
    """Attempt rows: the score with the time summed over the learner's visits."""
    spent = times.groupBy(*keys).agg(F.sum("seconds").alias("time_spent"), F.max("ts").alias("completed_at"))
    return scores.join(spent, list(keys), "left").withColumn("is_completed", F.lit(True))


def lab_summary(capsules: DataFrame, keys: Sequence[str] = ("lab_id",)) -> DataFrame:
    """Completion, mean score, time, bands and success rate of ``(keys, is_completed, score, time_spent)``."""
    done = F.col("is_completed")
    score = F.coalesce("score", F.lit(0))
    band = lambda low, high: F.count_if(done & (score >= low) & (score < high))
    out = capsules.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("capsules"), F.count_if(done).alias("completed"),
        F.coalesce(F.sum(F.when(done, score)), F.lit(0)).alias("_score"),
        F.coalesce(F.sum(F.when(done, F.coalesce("time_spent", F.lit(0)))), F.lit(0)).alias("total_time"),
        band(90, 10**9).alias("excellent"), band(80, 90).alias("good"), band(70, 80).alias("fair"),
        F.count_if(done & (score < 70)).alias("needs_improvement"),
    )
    passing = F.col("excellent") + F.col("good") + F.col("fair")
    return (
        out.withColumn("progress", progress("completed", "capsules"))
        .withColumn("average_score", half_up(ratio("_score", "completed", None)))
        .withColumn("success_rate", half_up(ratio(passing, "completed", None) * 100))
        .drop("_score")
    )


def progress(done: ColumnLike, total: ColumnLike) -> Column:
    """Share done in percent, 0 when there is nothing to do."""
    return F.when(col(total) > 0, col(done) / col(total) * 100).otherwise(F.lit(0.0))


def section_progress(nodes: DataFrame, keys: Sequence[str] = ("section_id",)) -> DataFrame:
    out = nodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("status") == "completed").alias("completed")
    )
    return out.withColumn("progress", progress("completed", "nodes"))


def next_incomplete(capsules: DataFrame, keys: Sequence[str] = ("lab_id",), position: str = "capsule_pos") -> DataFrame:
    """First capsule in order that is not completed; null when all are."""
    open_only = lambda c: F.when(~F.col("is_completed"), F.col(c))
    return capsules.groupBy(*keys).agg(F.min_by(open_only("capsule_id"), open_only(position)).alias("next_capsule_id"))


def review_events(reviews: DataFrame, options: DataFrame) -> DataFrame:
    """Reviews ``(question_id, option_id, confidence, seconds, ...)`` with their correct flag."""
    right = options.filter("is_correct").select("question_id", "option_id", F.lit(True).alias("is_correct"))
    return reviews.join(right, ["question_id", "option_id"], "left").withColumn("is_correct", F.coalesce("is_correct", F.lit(False)))


def session_measures() -> list[Column]:
    """Mergeable sums of one session; :func:`finish_sessions` turns them into the summary."""
    return [
        F.count(F.lit(1)).alias("items"), F.count_if("is_correct").alias("correct"),
        F.sum("confidence").alias("confidence_sum"), F.sum("seconds").alias("total_time"),
    ]


def finish_sessions(sessions: DataFrame) -> DataFrame:
    return (
        sessions.withColumn("accuracy_rate", half_up(F.col("correct") / F.col("items") * 100))
        .withColumn("average_confidence", F.col("confidence_sum") / F.col("items"))
        .drop("confidence_sum")
    )


def review_sessions(reviews: DataFrame, gap_seconds: int, bucket_seconds: int = 86400, key: str = "learner_id") -> DataFrame:
    """Sessions per learner: reviews less than ``gap_seconds`` apart belong together.

    Two levels, so that a learner with a third of all reviews is not one task: reviews are
    joined to islands inside time buckets first, then the few islands of a learner are chained.
    """
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = gap_seconds * 1_000_000
    bucketed = reviews.withColumn("_t", seconds).withColumn("_bucket", F.floor(F.col("_t") / (bucket_seconds * 1_000_000)))
    inside = Window.partitionBy(key, "_bucket").orderBy("_t")
    apart = F.coalesce(F.col("_t") - F.lag("_t").over(inside) >= gap, F.lit(True))
    islands = (
        bucketed.withColumn("_new", apart.cast("int"))
        .withColumn("_island", F.sum("_new").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "_bucket", "_island")
        .agg(F.min("_t").alias("_start"), F.max("_t").alias("_end"), *session_measures())
    )
    chain = Window.partitionBy(key).orderBy("_start")
    chained = islands.withColumn(
        "_new", F.coalesce(F.col("_start") - F.lag("_end").over(chain) >= gap, F.lit(True)).cast("int")
    ).withColumn("session_no", F.sum("_new").over(chain))
    out = chained.groupBy(key, "session_no").agg(
        F.timestamp_micros(F.min("_start")).alias("session_start"), F.timestamp_micros(F.max("_end")).alias("session_end"),
        *[F.sum(c).alias(c) for c in ("items", "correct", "confidence_sum", "total_time")],
    )
    return finish_sessions(out)


def priority_flag(is_correct: ColumnLike, confidence: ColumnLike) -> Column:
    """Wrong but confident -> priority; wrong -> reset; else null."""
    wrong = ~col(is_correct)
    return F.when(wrong & (col(confidence) >= MASTERY_CONFIDENCE), "priority").when(wrong, "reset")


def mastery(reviews: DataFrame, keys: Sequence[str] = ("learner_id", "item_id"), last: int = 10, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Strength over the last reviews, current streak, last confidence, mastered flag.

    The streak is the number of reviews after the last wrong one: two mergeable aggregates
    instead of a running window. Only the newest ``last`` rows per key meet in one task.
    """
    at = F.struct(*order)
    recent = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    strength = (
        reviews.withColumn("_rn", F.row_number().over(recent)).filter(F.col("_rn") <= last)
        .groupBy(*keys).agg(F.count_if("is_correct").alias("_right"), F.count(F.lit(1)).alias("_n"))
    )
    last_wrong = reviews.groupBy(*keys).agg(
        F.max(F.when(~F.col("is_correct"), at)).alias("_wrong"), F.count(F.lit(1)).alias("reviews"),
        F.max_by("confidence", at).alias("last_confidence"),
    )
    streak = (
        reviews.join(last_wrong.select(*keys, "_wrong"), list(keys))
        .filter(F.col("_wrong").isNull() | (at > F.col("_wrong")))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("streak"))
    )
    return (
        last_wrong.drop("_wrong").join(strength, list(keys)).join(streak, list(keys), "left")
        .withColumn("streak", F.coalesce("streak", F.lit(0)))
        .withColumn("strength", F.col("_right") / F.col("_n"))
        .withColumn(
            "is_mastered",
            (F.col("strength") >= MASTERY_STRENGTH) & (F.col("streak") >= MASTERY_STREAK) & (F.col("last_confidence") >= MASTERY_CONFIDENCE),
        )
        .drop("_right", "_n")
    )


def capped_interval(days: ColumnLike, most: int = MAX_INTERVAL_DAYS) -> Column:
    return F.least(col(days), F.lit(most))


def due_session(due: DataFrame, order: Sequence[str], size: int = DEFAULT_SESSION_ITEMS) -> DataFrame:
    """The next session: at most 50 of the due items, ten by default."""
    return due.orderBy(*order).limit(min(size, MAX_SESSION_ITEMS))
