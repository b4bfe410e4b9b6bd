"""Composite quality score per item, row-wise over the gate report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import ColumnLike, col
from lectern.operators.unnest import unnest

# fixed values: weights and thresholds
WEIGHTS = {"grounding": 0.30, "consistency": 0.25, "scope": 0.15, "distractors": 0.20, "novelty": 0.10}
ACCEPT, FLAG = 0.80, 0.65
SUGGESTIONS = {
    "grounding": "cite more quotes in the explanation",
    "consistency": "check stem and answer for contradictions or leaks",
    "scope": "stay within the allowed scope",
    "distractors": "make distractors plausible and distinct",
    "novelty": "set the item apart from similar ones",
}


def _gate(name: str) -> Column:
    return F.get(F.filter("checks", lambda c: c["gate_name"] == name), F.lit(0))


def grounding(required: ColumnLike, exact: ColumnLike, fuzzy: ColumnLike, missing: ColumnLike, least: int = 1) -> Column:
    """Quote counts -> presence, plus 0.2 for exactness, minus 0.2 per missing quote."""
    exact, found = col(exact), col(exact) + col(fuzzy)
    presence = F.least(found / F.lit(max(least, 1)), F.lit(1.0))
    bonus = F.when(found > 0, exact / found * 0.2).otherwise(0.0)
    score = F.least(F.greatest(presence + bonus - col(missing) * 0.2, F.lit(0.0)), F.lit(1.0))
    return F.when(col(required) == 0, F.lit(0.5)).otherwise(score)


def consistency() -> Column:
    both = F.filter("checks", lambda c: c["gate_name"].isin("stem_answer_consistency", "single_best_answer"))
    good = F.filter(both, lambda c: c["result"] == "pass")
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(good) / F.size(both))


def scope() -> Column:
    gate = _gate("scope_legality")
    return F.when(gate.isNull() | (gate["result"] == "pass"), 1.0).otherwise(0.0)


def distractors() -> Column:
    gate = _gate("distractor_quality")
    issues = F.coalesce(F.try_element_at(gate["details"], F.lit("issue_count")).cast("int"), F.lit(0))
    partial = F.greatest(1.0 - F.least(issues * 0.25, F.lit(0.75)), F.lit(0.25))
    return F.when(gate.isNull(), 0.8).when(gate["result"] == "pass", 1.0).otherwise(partial)


def novelty() -> Column:
    gate = _gate("novelty")
    similarity = F.coalesce(F.try_element_at(gate["details"], F.lit("similarity")).cast("double"), F.lit(0.0))
    return (
        F.when(gate.isNull() | (gate["result"] == "pass"), 1.0)
        .when(gate["result"] == "warn", F.greatest(1.0 - similarity, F.lit(0.3)))
        .otherwise(0.5)
    )


def quality_score(reports: DataFrame, min_quotes: int = 1) -> DataFrame:
    """Score a report row that carries ``required_count, exact_match_count, fuzzy_match_count,
    missing_quote_ids``: dimension scores, composite, decision and flags."""
    scored = (
        reports.withColumn(
            "grounding",
            grounding("required_count", "exact_match_count", "fuzzy_match_count", F.size("missing_quote_ids"), min_quotes),
        )
        .withColumn("consistency", consistency())
        .withColumn("scope", scope())
        .withColumn("distractor_score", distractors())
        .withColumn("novelty_score", novelty())
    )
    names = {
        "grounding": "grounding", "consistency": "consistency", "scope": "scope",
        "distractors": "distractor_score", "novelty": "novelty_score",
    }
    total = F.lit(0.0)
    for name, column in names.items():
        total = total + F.col(column) * WEIGHTS[name]
    composite = total / sum(WEIGHTS.values())
    dims = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).alias("score")) for n, c in names.items()])
    low = lambda d: F.when(d["score"] < 0.5, F.concat(F.lit("low_"), d["dimension"])).when(
        d["score"] < 0.7, F.concat(F.lit("borderline_"), d["dimension"])
    )
    return (
        scored.withColumn("_composite", composite)
        .withColumn("composite_score", F.round("_composite", 3))
        .withColumn("decision", decision("tier_1_passed", "_composite", "requires_repair"))
        .withColumn("dimension_scores", dims)
        .withColumn(
            "flags",
            F.concat("tier_3_flags", F.filter(F.transform("dimension_scores", low), lambda f: f.isNotNull())),
        )
        .drop("_composite")
    )


def decision(tier_1: ColumnLike, composite: ColumnLike, repairable: ColumnLike) -> Column:
    composite = col(composite)
    return (
        F.when(~col(tier_1), "reject")
        .when(composite >= ACCEPT, "accept")
        .when(composite >= FLAG, "accept_with_flags")
        .when(col(repairable), "repair")
        .otherwise("reject")
    )


def score_after_repair(rescored: DataFrame) -> DataFrame:
    """Second scores stand from the flag threshold on; below it the item is rejected."""
    failed = F.col("composite_score") < FLAG
    return rescored.withColumn("decision", F.when(failed, "reject").otherwise(F.col("decision"))).withColumn(
        "flags",
        F.when(failed, F.concat("flags", F.array(F.lit("failed_after_repair")))).otherwise(F.col("flags")),
    )


def improvement_suggestions(scored: DataFrame) -> DataFrame:
    """One row per item and dimension under 0.7."""
    text = F.create_map(*[F.lit(x) for kv in SUGGESTIONS.items() for x in kv])
    return (
        unnest(scored, "dimension_scores", ["item_id"], "d", "place")
        .filter(F.col("d.score") < 0.7)
        .select("item_id", "place", "d.dimension", F.element_at(text, F.col("d.dimension")).alias("suggestion"))
    )


def score_report(scored: DataFrame) -> DataFrame:
    """Readable report text per item."""
    bar = lambda s: F.concat(
        F.repeat(F.lit("█"), F.floor(s * 10).cast("int")), F.repeat(F.lit("░"), F.lit(10) - F.floor(s * 10).cast("int"))
    )
    lines = F.transform(
        "dimension_scores", lambda d: F.concat(F.lit("  "), F.rpad(d["dimension"], 15, " "), F.lit(" ["), bar(d["score"]), F.lit("] "), F.format_number(d["score"], 2))
    )
    flags = F.transform("flags", lambda f: F.concat(F.lit("  - "), f))
    text = F.concat(
        F.array(
            F.concat(F.lit("Quality of "), F.col("item_id").cast("string")),
            F.concat(F.lit("Score: "), F.format_number("composite_score", 2)),
            F.concat(F.lit("Decision: "), F.upper("decision")),
        ),
        lines,
        F.when(F.size(flags) > 0, F.concat(F.array(F.lit("Flags:")), flags)).otherwise(flags),
    )
    return scored.select("item_id", F.array_join(text, "\n").alias("report"))
