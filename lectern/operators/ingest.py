"""Model replies into hierarchy rows and item content; unreadable replies become failure rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import replies as R
from lectern.functions import text as T
from lectern.functions.text import ColumnLike
from lectern.operators.unnest import unnest

CONTENT = "stem string, options array<string>, correct_index int, explanation string, source_summary string"
# level: array key, entry fields, required fields
SHAPES = {
    "labs": (
        "struct<lab_id:string,title:string,description:string,objective:string,lab_type:string,"
        "estimated_duration_minutes:double,tools_required:array<string>,prerequisites_within_subtopic:array<string>,"
        "success_criteria:array<string>,real_world_application:string>",
        ("lab_id", "title", "objective", "lab_type"),
    ),
    "capsules": (
        "struct<capsule_id:string,title:string,description:string,learning_goal:string,capsule_type:string,"
        "estimated_duration_minutes:double,prerequisites_within_lab:array<string>,assessment_criteria:array<string>,"
        "common_errors:array<string>>",
        ("capsule_id", "title", "learning_goal", "capsule_type"),
    ),
    "items": (
        "struct<item_id:string,item_type:string,title:string,learning_target:string,difficulty:string>",
        ("item_id", "item_type", "title", "learning_target"),
    ),
}
OVERVIEW = (
    "overview struct<target_audience:string,course_description:string,total_estimated_study_hours:double,"
    "study_strategies:array<struct<name:string,description:string,when_to_use:string>>,exam_day_tips:array<string>,"
    "prerequisites_detail:array<string>>,"
    "question_type_guides array<struct<question_type_name:string,detailed_structure:string,"
    "difficulty_scaling_notes:string,answer_choice_design_notes:string>>"
)


def capped_summary(text: ColumnLike, words: int = 150) -> Column:
    """At most 150 words, then an ellipsis."""
    parts = T.split_words(text)
    return F.when(
        F.size(parts) > words, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("..."))
    ).otherwise(T.col(text))


def ingest_content(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``replies(item_id, reply)`` -> item contents, and failure rows."""
    marked = replies.withColumn("_ok", R.is_object("reply"))
    good = marked.filter("_ok").withColumn("r", R.read_as("reply", CONTENT)).select(
        "item_id", R.default_text("r.stem").alias("stem"), R.empty_texts("r.options").alias("options"),
        F.coalesce("r.correct_index", F.lit(0)).alias("correct_index"),
        R.default_text("r.explanation").alias("explanation"),
        capped_summary(R.default_text("r.source_summary")).alias("source_summary"),
    )
    bad = marked.filter(~F.col("_ok")).select("item_id", F.lit(False).alias("success"), F.lit("reply is not a JSON object").alias("error"))
    return good, bad


def ingest_level(replies: DataFrame, level: str, key: str = "parent_id") -> tuple[DataFrame, DataFrame]:
    """``replies(key, reply)`` with labs, capsules or item outlines -> entry rows, failure rows.

    One entry without a required key fails the whole reply.
    """
    shape, required = SHAPES[level]
    rows = replies.withColumn("_ok", R.is_object("reply")).withColumn(
        "entries", F.coalesce(R.read_as("reply", f"{level} array<{shape}>")[level], F.expr(f"cast(array() as array<{shape}>)"))
    )
    complete = F.forall("entries", lambda e: ~F.greatest(*[e[f].isNull() for f in required]))
    rows = rows.withColumn("_complete", complete)
    good = rows.filter(F.col("_ok") & F.col("_complete"))
    fields = [f.split(":")[0] for f in shape[len("struct<"):-1].split(",")]
    lists = {f.split(":")[0] for f in shape.split(",") if "array<string>" in f}
    entry = lambda f: R.empty_texts(f"e.{f}").alias(f) if f in lists else F.col(f"e.{f}").alias(f)
    out = unnest(good, "entries", [key], "e", "pos").select(key, "pos", *[entry(f) for f in fields])
    bad = rows.filter(~(F.col("_ok") & F.col("_complete"))).select(
        key, F.lit(False).alias("success"),
        F.when(~F.col("_ok"), "reply is not a JSON object").otherwise("required key missing").alias("error"),
    )
    return out, bad


def ingest_overview(replies: DataFrame, key: str = "course_id") -> DataFrame:
    """Course overview and question-type guides; a guide without type name fails the reply."""
    rows = replies.withColumn("r", R.read_as("reply", OVERVIEW))
    named = F.coalesce(F.forall("r.question_type_guides", lambda g: g["question_type_name"].isNotNull()), F.lit(True))
    ok = R.is_object("reply") & named
    return rows.select(
        key, F.when(ok, F.col("r.overview")).alias("overview"), F.when(ok, F.col("r.question_type_guides")).alias("guides"),
        ok.alias("success"), F.when(~ok, "overview reply not usable").alias("error"),
    )


def ingest_anchored(replies: DataFrame) -> DataFrame:
    """Anchored-question replies; one that is no JSON object gives no row."""
    schema = "stem string, options array<string>, correct_index int, explanation string, source_summary string, anchor_usage array<string>"
    good = replies.filter(R.is_object("reply")).withColumn("r", R.read_as("reply", schema))
    return good.select("item_id", "r.*").withColumn("options", R.empty_texts("options")).withColumn(
        "correct_answer", F.get("options", F.coalesce("correct_index", F.lit(0)))
    )


def fill_items(items: DataFrame, contents: DataFrame) -> DataFrame:
    """Items with generated content in place; items without a reply stay as they are."""
    new = contents.select(
        "item_id", F.col("stem").alias("_stem"), F.col("options").alias("_options"),
        F.col("correct_index").alias("_index"), F.col("explanation").alias("_explanation"),
    )
    return items.join(new, "item_id", "left").withColumn("generation_status", F.when(F.col("_stem").isNotNull(), "success").otherwise(
        F.col("generation_status") if "generation_status" in items.columns else F.lit("pending")
    )).withColumn("content", F.coalesce("_stem", "content")).withColumn("options", F.coalesce("_options", "options")).withColumn(
        "correct_answer_index", F.coalesce("_index", "correct_answer_index")
    ).withColumn("explanation", F.coalesce("_explanation", "explanation")).drop("_stem", "_options", "_index", "_explanation")


def run_model(requests: DataFrame, batch_function, schema: str) -> DataFrame:
    """Requests through a user's batch model function (an iterator of pandas frames)."""
    return requests.mapInPandas(batch_function, schema)
