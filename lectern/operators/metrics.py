"""Quality records and metrics, citations, stage summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lectern.functions.text import ColumnLike, col

RECORD = (
    "item_id string, capsule_id string, has_evidence boolean, evidence_chunk_count int, quote_count int,"
    " verified_quote_count int, checked_ambiguity boolean, is_clear boolean, checked_novelty boolean,"
    " is_novel boolean, similar_to string, passed_first boolean, was_repaired boolean, was_rejected boolean,"
    " difficulty string, status string"
)


def ratio(part: ColumnLike, whole: ColumnLike, digits: int | None = 4) -> Column:
    """Guarded ratio: 0 when the whole is 0."""
    value = F.when(col(whole) > 0, col(part) / col(whole)).otherwise(F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def half_up(value: Column) -> Column:
    """Round halves up, as scores are shown to learners."""
    return F.floor(value + F.lit(0.5))


def item_records(
    items: DataFrame, verification: DataFrame | None = None, novelty: DataFrame | None = None,
    keys: Sequence[str] = ("capsule_id", "item_pos"),
) -> DataFrame:
    """One record per item; results join by capsule and position, absent ones leave defaults.

    ``items(capsule_id, item_pos, item_id, difficulty, generation_status, chunk_ids,
    quotes_found array<boolean>)``, ``verification(.., status)``, ``novelty(.., is_novel,
    similar_tag)``.
    """
    on = list(keys)
    joined = items
    joined = joined.join(verification.select(*on, F.col("status").alias("_verdict")), on, "left") if verification is not None else joined.withColumn("_verdict", F.lit(None).cast("string"))
    if novelty is not None:
        joined = joined.join(novelty.select(*on, F.col("is_novel").alias("_novel"), F.col("similar_tag").alias("_tag"), F.lit(True).alias("_checked")), on, "left")
    else:
        joined = joined.withColumn("_novel", F.lit(None).cast("boolean")).withColumn("_tag", F.lit(None).cast("string")).withColumn("_checked", F.lit(None).cast("boolean"))
    chunks = F.coalesce(F.size("chunk_ids"), F.lit(0))
    return joined.select(
        *on, "item_id",
        (chunks > 0).alias("has_evidence"), chunks.alias("evidence_chunk_count"),
        F.coalesce(F.size("quotes_found"), F.lit(0)).alias("quote_count"),
        F.coalesce(F.size(F.filter("quotes_found", lambda q: q)), F.lit(0)).alias("verified_quote_count"),
        F.lit(False).alias("checked_ambiguity"), F.lit(True).alias("is_clear"),
        F.coalesce("_checked", F.lit(False)).alias("checked_novelty"), F.coalesce("_novel", F.lit(True)).alias("is_novel"),
        F.col("_tag").alias("similar_to"),
        (~F.coalesce(F.col("_verdict").isin("repair", "reject"), F.lit(False))).alias("passed_first"),
        F.coalesce(F.col("_verdict") == "repair", F.lit(False)).alias("was_repaired"),
        F.coalesce(F.col("_verdict") == "reject", F.lit(False)).alias("was_rejected"),
        F.coalesce(F.when(F.col("difficulty") != "", F.col("difficulty")), F.lit("intermediate")).alias("difficulty"),
        F.coalesce(F.when(F.col("generation_status") != "", F.col("generation_status")), F.lit("success")).alias("status"),
    )


def measures() -> list[Column]:
    """The aggregates of one metrics row; all mergeable, also usable on a stream."""
    checked, novel = F.col("checked_novelty"), F.col("is_novel")
    return [
        F.count(F.lit(1)).alias("total_items"),
        F.count_if("has_evidence").alias("items_with_evidence"),
        F.coalesce(F.sum("quote_count"), F.lit(0)).alias("total_quotes"),
        F.coalesce(F.sum("verified_quote_count"), F.lit(0)).alias("verified_quotes"),
        F.count_if("checked_ambiguity").alias("items_checked_ambiguity"),
        F.count_if(F.col("checked_ambiguity") & F.col("is_clear")).alias("items_clear_answer"),
        F.count_if(checked).alias("items_checked_novelty"),
        F.count_if(checked & novel).alias("items_novel"),
        F.count_if(checked & ~novel).alias("items_duplicate"),
        F.count_if("passed_first").alias("items_passed_first"),
        F.count_if("was_repaired").alias("items_repaired"),
        F.count_if("was_rejected").alias("items_rejected"),
    ]


def with_ratios(counts: DataFrame) -> DataFrame:
    return (
        counts.withColumn("evidence_coverage_ratio", ratio("items_with_evidence", "total_items"))
        .withColumn("quote_verification_rate", ratio("verified_quotes", "total_quotes"))
        .withColumn("single_answer_rate", ratio("items_clear_answer", "items_checked_ambiguity"))
        .withColumn("duplicate_concept_rate", ratio("items_duplicate", "items_checked_novelty"))
        .withColumn("repair_loop_rate", ratio("items_repaired", "total_items"))
        .withColumn("rejection_rate", ratio("items_rejected", "total_items"))
    )


def quality_metrics(records: DataFrame) -> DataFrame:
    """One row over all records.

    Capsules are folded first, so the distinct count is a plain sum over capsule rows.
    """
    per_capsule = records.groupBy("capsule_id").agg(*measures())
    names = [c for c in per_capsule.columns if c != "capsule_id"]
    total = per_capsule.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names], F.count(F.lit(1)).alias("total_capsules")
    )
    return with_ratios(total)


def capsule_metrics(records: DataFrame) -> DataFrame:
    return with_ratios(records.groupBy("capsule_id").agg(*measures()))


def distribution(records: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by value as rows; null and empty are ``unknown``."""
    value = F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit("unknown"))
    return records.groupBy(*keys, value.alias(column)).agg(F.count(F.lit(1)).alias("items"))


def distribution_map(records: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """The same as one map per key; the values are a short fixed vocabulary."""
    rows = distribution(records, column, keys)
    entries = F.array_sort(F.collect_list(F.struct(column, "items")))
    return rows.groupBy(*keys).agg(F.map_from_entries(entries).alias(f"{column}_distribution"))


def metrics_report(metrics: DataFrame, title: str = "Quality metrics") -> DataFrame:
    percent = lambda c: F.concat(F.format_number(F.col(c) * 100, 1), F.lit("%"))
    number = lambda c: F.col(c).cast("string")
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    text = F.concat_ws(
        "\n", F.lit(title), line("Items", number("total_items")),
        line("Evidence coverage", percent("evidence_coverage_ratio")), line("Quote verification", percent("quote_verification_rate")),
        line("Single answer", percent("single_answer_rate")), line("Duplicates", percent("duplicate_concept_rate")),
        line("Passed first", number("items_passed_first")),
        F.concat(line("Repaired", number("items_repaired")), F.lit(" ("), percent("repair_loop_rate"), F.lit(")")),
        F.concat(line("Rejected", number("items_rejected")), F.lit(" ("), percent("rejection_rate"), F.lit(")")),
    )
    return metrics.select("*", text.alias("report"))


def merge_citations(used: DataFrame, keys: Sequence[str] = ("item_id",), first: int | None = None) -> DataFrame:
    """Citations of an item's chunks ``(keys, chunk_pos, book_title, book_author, pages)``.

    One citation per (title, author) in first-seen order. A first chunk gives its pages as they
    are; later ones of a known book add the pages that are new, to the first citation with that
    title. An item uses a handful of chunks; with ``first`` only its chunks of those first positions count.
    """
    used = used if first is None else used.filter(F.col("chunk_pos") < first)
    ordered = used.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("chunk_pos", "book_title", "book_author", "pages"))).alias("c")
    )
    citation = "struct<book_title:string,book_author:string,pages:array<int>>"

    def add(done: Column, x: Column) -> Column:
        known = F.exists(done, lambda d: (d["book_title"] == x["book_title"]) & (d["book_author"] == x["book_author"]))
        titles = F.transform(done, lambda d: d["book_title"])
        first = F.array_position(titles, x["book_title"])
        grown = F.transform(
            done,
            lambda d, i: F.when(
                i + 1 == first,
                d.withField("pages", F.concat(d["pages"], F.filter(x["pages"], lambda p: ~F.array_contains(d["pages"], p)))),
            ).otherwise(d),
        )
        new = F.struct(x["book_title"].alias("book_title"), x["book_author"].alias("book_author"), x["pages"].alias("pages"))
        return F.when(known, grown).otherwise(F.array_append(done, new))

    start = F.expr(f"cast(array() as array<{citation}>)")
    return ordered.select(*keys, F.aggregate("c", start, add).alias("citations"))


def stage_summary(rows: DataFrame, keys: Sequence[str] = (), success: str = "success") -> DataFrame:
    """Processed and failed counts of a stage's result rows."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(success)).alias("succeeded"), F.count_if(~F.col(success)).alias("failed")
    )


def observe_stage(
    rows: DataFrame, observation: Observation | str, success: str = "success", kind: str | None = None, kinds: Sequence[str] = (),
) -> DataFrame:
    """``rows`` unchanged; while they are written, counts of a stage are taken in the same pass.

    ``total, succeeded, failed`` (a null counts as failed), with ``kind`` also one count for each of the
    fixed ``kinds`` and ``other`` for what is none of them. Batch: an ``Observation``, read by ``.get`` after the
    action. Stream: a name; the counts are in the query's progress (:func:`lectern.streaming.jobs.observed_counts`).
    """
    good = F.coalesce(F.col(success), F.lit(False))
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed")]
    if kind is not None:
        counts += [F.count_if(F.col(kind) == k).alias(k) for k in kinds]
        counts.append(F.count_if(~F.coalesce(F.col(kind).isin(list(kinds)), F.lit(False))).alias("other"))
    return rows.observe(observation, *counts)
