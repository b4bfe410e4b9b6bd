"""Exam formats: tolerant reading, the flat form, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import replies as R
from lectern.functions import text as T
from lectern.functions.text import ColumnLike, col
from lectern.sources import schemas as S

FLAT = (
    "certification_name string, exam_code string, num_questions int, time_limit_minutes int, passing_score string,"
    " prerequisites array<string>, cost_usd double, validity_years double, delivery_methods array<string>,"
    " languages array<string>, recertification_policy string, additional_notes string,"
    " domains array<struct<name:string,weight_pct:double,description:string>>"
)
TYPE = "struct<name:string,description:string,purpose:string,grading_notes:string>"


def _list(value: ColumnLike, ddl: str) -> Column:
    return F.coalesce(col(value), F.expr(f"cast(array() as array<{ddl}>)"))


def read_components(replies: DataFrame) -> DataFrame:
    """``replies(certification, reply)`` -> the multi-component format, every default filled."""
    text = R.default_text

    def domain(d: Column) -> Column:
        return F.struct(
            text(d["name"], "Unknown").alias("name"), d["weight_min_pct"].alias("weight_min_pct"),
            d["weight_max_pct"].alias("weight_max_pct"), d["weight_pct"].alias("weight_pct"),
            d["description"].alias("description"), text(d["source_type"], "inferred").alias("source_type"),
        )

    def item_class(i: Column) -> Column:
        return F.struct(
            text(i["name"], "unknown").alias("name"), i["display_name"].alias("display_name"),
            F.coalesce(i["is_tei"], F.lit(False)).alias("is_tei"),
            text(i["interaction_model"], "single_select").alias("interaction_model"),
            F.coalesce(i["allowed_context_types"], T.words_array(["scenario", "direct"])).alias("allowed_context_types"),
            text(i["patient_presence"], "optional").alias("patient_presence"),
            F.coalesce(i["age_representation"], T.words_array(["exact", "broad", "none"])).alias("age_representation"),
            i["description"].alias("description"), text(i["grading"], "unknown").alias("grading"),
            i["estimated_percentage"].alias("estimated_percentage"), text(i["source_type"], "inferred").alias("source_type"),
        )

    def component(c: Column) -> Column:
        same = ("display_name", "description")
        numbers = ("num_questions", "num_questions_min", "num_questions_max", "pilot_unscored_items", "time_limit_minutes")
        return F.struct(
            text(c["name"], "cognitive").alias("name"), *[c[f].alias(f) for f in same],
            F.coalesce(c["adaptive"], F.lit(False)).alias("adaptive"), c["adaptive_algorithm"].alias("adaptive_algorithm"),
            *[c[f].alias(f) for f in numbers],
            R.empty_texts(c["delivery_methods"]).alias("delivery_methods"), c["passing_score"].alias("passing_score"),
            text(c["passing_score_source"], "unknown").alias("passing_score_source"),
            F.transform(_list(c["domains"], S.DOMAIN_V2), domain).alias("domains"),
            F.transform(_list(c["item_classes"], S.ITEM_CLASS), item_class).alias("item_classes"),
        )

    facts = F.transform(
        _list("r.source_facts", S.FACT),
        lambda f: F.struct(
            text(f["field"]).alias("field"), f["value"].alias("value"), text(f["source_type"], "inferred").alias("source_type"),
            f["source_title"].alias("source_title"), f["source_url"].alias("source_url"), text(f["confidence"], "medium").alias("confidence"),
        ),
    )
    rows = replies.filter(R.is_object("reply")).withColumn("r", R.read_as("reply", S.EXAM_V2))
    keep = ("certification_code", "certifying_body", "exam_code", "cost_usd", "validity_years", "recertification_policy")
    return rows.select(
        F.coalesce("r.certification_name", "certification").alias("certification_name"),
        *[F.col(f"r.{f}").alias(f) for f in keep],
        R.empty_texts("r.prerequisites").alias("prerequisites"), R.empty_texts("r.languages").alias("languages"),
        F.transform(_list("r.exam_components", S.COMPONENT), component).alias("exam_components"), facts.alias("source_facts"),
    )


def domain_weight(domain: Column) -> Column:
    """The domain's weight, or the middle of its range (zero counts as absent)."""
    low, high = domain["weight_min_pct"], domain["weight_max_pct"]
    both = (F.coalesce(low, F.lit(0.0)) != 0) & (F.coalesce(high, F.lit(0.0)) != 0)
    return F.coalesce(F.when(domain["weight_pct"] != 0, domain["weight_pct"]), F.when(both, (low + high) / 2))


def flatten_components(formats: DataFrame) -> DataFrame:
    """One flat format per exam: first known question count and time, all domains and types."""
    parts = F.col("exam_components")
    first = lambda f: F.get(F.filter(F.transform(parts, f), lambda x: x.isNotNull()), F.lit(0))
    each = lambda f, make: F.flatten(F.transform(parts, lambda c: F.transform(c[f], make)))
    count = lambda c: F.coalesce(F.when(c["num_questions"] != 0, c["num_questions"]), c["num_questions_max"])
    domain = lambda d: F.struct(d["name"].alias("name"), domain_weight(d).alias("weight_pct"), d["description"].alias("description"))
    kind = lambda i: F.struct(
        F.coalesce(F.when(i["display_name"] != "", i["display_name"]), i["name"]).alias("name"), i["description"].alias("description"),
        F.concat(F.lit("TEI: "), i["is_tei"].cast("string"), F.lit(", Context: "), F.array_join(i["allowed_context_types"], ", ")).alias("purpose"),
        i["grading"].alias("grading_notes"),
    )
    return formats.select(
        "certification_name", "exam_code", first(count).alias("num_questions"),
        first(lambda c: c["time_limit_minutes"]).alias("time_limit_minutes"),
        F.get(F.transform(parts, lambda c: c["passing_score"]), F.lit(0)).alias("passing_score"),
        each("domains", domain).alias("domains"), each("item_classes", kind).alias("question_types"),
        F.array_distinct(F.flatten(F.transform(parts, lambda c: c["delivery_methods"]))).alias("delivery_methods"),
        "prerequisites", "languages", "cost_usd", "validity_years", "recertification_policy",
    )


def read_flat(replies: DataFrame) -> DataFrame:
    """Flat format replies; question types may be names or objects, mixed in one list."""
    rows = replies.filter(R.is_object("reply")).withColumn("r", R.read_as("reply", FLAT)).withColumn(
        "_types", R.read_as("reply", "question_types array<variant>")["question_types"]
    )
    as_object = lambda v, f: F.try_variant_get(v, f"$.{f}", "string")
    kind = lambda v: F.struct(
        F.coalesce(as_object(v, "name"), F.try_variant_get(v, "$", "string")).alias("name"),
        as_object(v, "description").alias("description"), as_object(v, "purpose").alias("purpose"), as_object(v, "grading_notes").alias("grading_notes"),
    )
    is_known = lambda v: F.schema_of_variant(v).rlike("^(STRING|OBJECT)")
    types = F.transform(F.filter(_list("_types", "variant"), is_known), kind)
    names = [f.strip().split(" ")[0] for f in FLAT.split(", ") if f.split(" ")[0] and not f.startswith("domains")]
    plain = [n for n in names if n not in ("certification_name", "prerequisites", "delivery_methods", "languages", "domains")]
    return rows.select(
        F.coalesce("r.certification_name", "certification").alias("certification_name"), *[F.col(f"r.{n}").alias(n) for n in plain],
        *[R.empty_texts(f"r.{n}").alias(n) for n in ("prerequisites", "delivery_methods", "languages")],
        _list("r.domains", "struct<name:string,weight_pct:double,description:string>").alias("domains"), types.alias("question_types"),
    )


def repaired_weight(reply: ColumnLike, weight_pct: ColumnLike, low: ColumnLike, high: ColumnLike) -> Column:
    """Module weight of a reply: fractions become percent; only an absent key falls back to
    the domain's weight or range middle, an explicit null stays null."""
    value = F.try_variant_get(R.parsed(reply), "$.domain_weight_pct", "double")
    fallback = F.coalesce(col(weight_pct), (col(low) + col(high)) / 2)
    return F.when(~R.has_key(reply, "$.domain_weight_pct"), fallback).when(value < 1, value * 100).otherwise(value)
