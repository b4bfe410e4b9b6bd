"""Whole jobs, composed from the operators. A user step is any DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import ambiguity, claims, gates, metrics, novelty, quotes, scoring, validation
from lectern.operators.chunking import assign_chunk_ids, chunk_books
from lectern.operators.corrections import apply_queue, build_queue, correct_documents, course_status, new_versions
from lectern.operators.durable import durable
from lectern.operators.hierarchy import flatten, nest, put_back
from lectern.operators.routing import collection_plan, distinct_files, fan_out, top_folder
from lectern.plans.presets import BALANCED, QualityConfig
from lectern.sources.readers import book_files
from lectern.sources.store import rebuild_collections, upsert_collections

Step = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, *steps: Step) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def embed_books(
    spark: SparkSession, root: str, store: str, add_vectors: Step, mapping: DataFrame | None = None,
    rebuild: bool = False, dry_run: bool = False,
) -> DataFrame:
    """Book folders -> chunks -> vectors -> collections; returns the plan.

    Each book is chunked and gets its vectors once, then fans out to its collections.
    """
    books = book_files(spark, root).withColumn("folder", top_folder("path", root)).filter("folder is not null")
    plan = collection_plan(books.select("path", "title", "folder"), mapping)
    if dry_run:
        return plan
    once = distinct_files(books.withColumn("collection", F.lit(None).cast("string"))).select(
        F.col("path").alias("book_id"), "markdown", "blocks", F.col("title").alias("book_title"),
        F.lit("Unknown").alias("book_author"), F.col("path").alias("source_file"),
    )
    chunks = add_vectors(chunk_books(once))
    placed = assign_chunk_ids(fan_out(chunks.withColumnRenamed("book_id", "path"), plan), ("path", "chunk_pos"))
    if rebuild:
        rebuild_collections(placed, store, plan)
    else:
        upsert_collections(placed, store)
    return plan


def quality_check(
    items: DataFrame, links: DataFrame, item_quotes: DataFrame, allowed_tags: list[str],
    config: QualityConfig = BALANCED, target_difficulty: str = "medium",
) -> DataFrame:
    """Verification, gates, novelty and score per item; parts a preset turns off are left out.

    ``items(item_id, pos, stem, correct_answer, distractors, explanation, scope_tags, difficulty,
    learning_target, required_quote_ids)``, ``links(item_id, chunk_id, chunk_pos, text)``,
    ``item_quotes(item_id, quote_id, text)``.
    """
    used = item_quotes.groupBy("item_id").agg(F.lit(True).alias("has_quotes"))
    checked = quotes.verify_quotes(
        items.select("item_id", F.col("explanation").alias("generated_text"), "required_quote_ids"), item_quotes
    )
    rows = items.join(checked, "item_id").join(used, "item_id", "left").withColumn(
        "has_quotes", F.coalesce("has_quotes", F.lit(False))
    )
    if config.use_novelty_gate:
        soft = novelty.soft_novelty(items.select("item_id", "pos", "stem", "correct_answer"))
        rows = rows.join(soft.select("item_id", "similarity", "similar_item_id"), "item_id")
    gated = gates.run_gates(rows, allowed_tags, target_difficulty, with_quotes=True, with_novelty=config.use_novelty_gate)
    out = scoring.quality_score(gates.gate_report(gated))
    if config.use_verification_loop:
        mode = "strict" if config.mode == "strict" else "balanced"
        verdicts = claims.verify_items(items, links, mode).select("item_id", F.col("status").alias("verification"))
        out = out.join(verdicts, "item_id")
    if config.use_ambiguity_gate:
        options = items.select(
            "item_id", F.concat(F.array("correct_answer"), F.col("distractors")).alias("options"), F.lit(0).alias("correct_index")
        )
        out = out.join(ambiguity.quick_verdict(options).select("item_id", F.col("status").alias("ambiguity")), "item_id")
    return out


def validate_and_correct(
    courses: DataFrame, replies: DataFrame | None, source_version: int = 1
) -> dict[str, DataFrame]:
    """Course documents -> results, report, queue, new item rows, outcome, status, and the corrected
    documents in their new version (:func:`lectern.sources.store.write_version` keeps them)."""
    results = durable(validation.validate_documents(courses))
    queue = durable(build_queue(results))
    fixed, outcome_of_fields = correct_documents(courses, queue)
    fixed = durable(fixed)
    fields = fixed.schema["domain_modules"].dataType.elementType
    for name in ("topics", "subtopics", "labs", "capsules", "items"):
        fields = fields[name].dataType.elementType
    rows = flatten(fixed, "item").select("course_id", "entity_path", "item_pos", "item.*")
    new_items, outcome = apply_queue(rows, queue.filter("action_type <> 'auto_fix'"), replies)
    new_items = durable(new_items)
    children = new_items.select(
        "course_id", F.slice("entity_path", 1, F.size("entity_path") - 1).alias("entity_path"), "item_pos", F.struct(*fields.names).alias("item"))
    nested = nest(children, ["course_id", "entity_path"], "item_pos", "items")
    filled = nested.select("course_id", "entity_path", F.transform("items", lambda x: x["item"]).alias("items"), F.lit(True).alias("success"))
    # where two capsules have one path, their items can't be told apart and stay as they are
    capsules = flatten(fixed, "capsule").groupBy("course_id", "entity_path").agg(F.count("*").alias("n")).filter("n = 1")
    filled = filled.join(capsules, ["course_id", "entity_path"], "left_semi")
    outcome = durable(outcome.unionByName(outcome_of_fields))
    status = course_status(outcome, source_version)
    items = new_items.drop("item_pos")
    return {
        "courses": new_versions(put_back(fixed, filled), status),
        "results": results, "report": validation.report(results), "queue": queue, "items": items,
        "outcome": outcome, "status": status,
    }


def record_quality(items: DataFrame, verification: DataFrame, novelty_results: DataFrame) -> DataFrame:
    """Metrics row over item records."""
    return metrics.quality_metrics(metrics.item_records(items, verification, novelty_results))
