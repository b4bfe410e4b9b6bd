"""Question types and typed question replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import replies as R
from lectern.functions.naming import type_name
from lectern.functions.text import ColumnLike, col

CHOICE = "struct<label:string,text:string,is_correct:boolean>"
# payload per type; the discriminator is ``question_type``
PAYLOADS = {
    "multiple_choice": f"struct<stem:string,choices:array<{CHOICE}>,correct_label:string>",
    "multiple_response": f"struct<stem:string,num_correct:int,choices:array<{CHOICE}>,correct_labels:array<string>>",
    "drag_drop": "struct<stem:string,drag_items:array<struct<id:string,text:string>>,drop_zones:array<struct<id:string,label:string,accepts:array<string>>>>",
    "hotspot": "struct<stem:string,image_url:string,regions:array<struct<id:string,label:string,is_correct:boolean>>,num_correct_regions:int>",
    "fill_blank": "struct<stem_with_blanks:string,blanks:array<struct<id:string,acceptable_answers:array<string>>>>",
    "ordering": "struct<stem:string,items:array<struct<id:string,text:string>>,correct_order:array<string>>",
    "simulation": "struct<stem:string,environment_description:string,initial_state:string,tasks:array<string>>",
    "case_study": "struct<scenario:string,exhibits:array<string>,sub_questions:array<string>>",
}
COMMON = "question_type string, correct_answer_explanation string, difficulty string, source_indices array<int>"


def parse_questions(replies: DataFrame) -> DataFrame:
    """``replies(question_id, reply, ..)`` -> common columns and one nullable struct per type."""
    rows = replies.filter(R.is_object("reply")).withColumn("_c", R.read_as("reply", COMMON))
    kind = type_name(F.coalesce("_c.question_type", F.lit("")))
    rest = [c for c in replies.columns if c != "reply"]
    typed = [
        F.when(kind == name, F.from_json(R.strip_fences("reply"), ddl)).alias(name) for name, ddl in PAYLOADS.items()
    ]
    return rows.select(
        *rest, kind.alias("question_type"), F.col("_c.correct_answer_explanation").alias("explanation"),
        F.col("_c.difficulty").alias("difficulty"), F.coalesce("_c.source_indices", F.array().cast("array<int>")).alias("source_indices"), *typed,
    )


def attach_sources(indices: ColumnLike, references: ColumnLike) -> Column:
    """References named by 0-based index; indexes out of range give nothing."""
    found = F.transform(col(indices), lambda i: F.get(col(references), i))
    return F.filter(found, lambda r: r.isNotNull())


def highlights(reply: ColumnLike, chunk: ColumnLike) -> Column:
    """``array<struct<text, start_char, end_char>>``: strings are located in the chunk, given
    spans are kept."""
    listed = R.read_as(reply, "highlights array<variant>")["highlights"]

    def one(h: Column) -> Column:
        text = F.try_variant_get(h, "$", "string")
        is_text = F.schema_of_variant(h) == "STRING"
        start = F.position(text, col(chunk)) - 1
        return F.when(
            is_text,
            F.struct(
                text.alias("text"), F.when(start >= 0, start).alias("start_char"),
                F.when(start >= 0, start + F.length(text)).alias("end_char"),
            ),
        ).otherwise(
            F.struct(
                F.try_variant_get(h, "$.text", "string").alias("text"), F.try_variant_get(h, "$.start_char", "int").alias("start_char"),
                F.try_variant_get(h, "$.end_char", "int").alias("end_char"),
            )
        )

    return F.transform(F.coalesce(listed, F.expr("cast(array() as array<variant>)")), one)


def extend_registry(registry: DataFrame, names: DataFrame) -> DataFrame:
    """The type registry plus unseen types, scored by hand until someone describes them."""
    unseen = names.select(type_name("name").alias("question_type")).filter("question_type <> ''").distinct().join(
        registry.select("question_type"), "question_type", "left_anti"
    )
    shape = registry.schema["definition"].dataType
    default = F.struct(*[
        (F.lit("manual") if f.name == "scoring" else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields
    ])
    return registry.unionByName(unseen.withColumn("definition", default))


def type_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("question_type").agg(F.count(F.lit(1)).alias("questions"))
