"""Item plans and query plans: reply ingest, fallbacks, validation, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import lexicon as lex
from lectern.functions import replies as R
from lectern.functions import text as T
from lectern.functions.text import ColumnLike, col
from lectern.operators.ambiguity import repeated
from lectern.operators.unnest import unnest

LOCK = "struct<lock_type:string,constraint_text:string,eliminates_options:array<string>>"
SUPPORT = "struct<quote_id:string,role:string,supports_claim:string>"
DISTRACTOR = (
    "struct<text:string,tag:string,failure_reason:string,why_wrong:string,"
    "stem_fact_violated:string,plausibility_source:string>"
)
PLAN_REPLY = (
    f"question_type string, hazard_cues array<string>, scenario_context string, decision_locks array<{LOCK}>,"
    " correct_action string, correct_option_text string, why_correct string, discriminating_factor string,"
    f" support_mapping array<{SUPPORT}>, distractors array<{DISTRACTOR}>, scope_tags array<string>,"
    " out_of_scope_warning string, stem_type string, stem_constraints array<string>"
)
QUERY_REPLY = (
    "queries array<struct<query_text:string,intent:string,must_include:array<string>,priority:int>>,"
    " must_include_keywords array<string>"
)


def _empty(ddl: str) -> Column:
    return F.expr(f"cast(array() as array<{ddl}>)")


def ingest_plans(replies: DataFrame) -> DataFrame:
    """``replies(item_id, learning_target, reply)`` -> plans; unknown choices get defaults."""
    r = lambda name: F.col(f"r.{name}")
    rows = replies.filter(R.is_object("reply")).withColumn("r", R.read_as("reply", PLAN_REPLY))
    return rows.select(
        "item_id", "learning_target",
        R.one_of(r("question_type"), lex.QUESTION_KINDS, "factual").alias("question_type"),
        R.empty_texts(r("hazard_cues")).alias("hazard_cues"),
        r("scenario_context").alias("scenario_context"),
        F.transform(
            F.coalesce(r("decision_locks"), _empty(LOCK)),
            lambda x: F.struct(
                R.one_of(x["lock_type"], lex.LOCK_TYPES, "feasibility").alias("lock_type"),
                R.default_text(x["constraint_text"]).alias("constraint_text"),
                R.empty_texts(x["eliminates_options"]).alias("eliminates_options"),
            ),
        ).alias("decision_locks"),
        *[R.default_text(r(n)).alias(n) for n in ("correct_action", "correct_option_text", "why_correct", "discriminating_factor")],
        F.transform(
            F.coalesce(r("support_mapping"), _empty(SUPPORT)),
            lambda x: F.struct(
                R.default_text(x["quote_id"]).alias("quote_id"),
                R.default_text(x["role"], "primary_support").alias("role"),
                R.default_text(x["supports_claim"]).alias("supports_claim"),
            ),
        ).alias("support_mapping"),
        F.transform(
            F.coalesce(r("distractors"), _empty(DISTRACTOR)),
            lambda x: F.struct(
                R.default_text(x["text"]).alias("text"),
                R.one_of(x["tag"], lex.DISTRACTOR_TAGS, "partial").alias("tag"),
                R.one_of(x["failure_reason"], lex.FAILURE_REASONS, "too_generic").alias("failure_reason"),
                R.default_text(x["why_wrong"]).alias("why_wrong"),
                R.default_text(x["stem_fact_violated"]).alias("stem_fact_violated"),
                x["plausibility_source"].alias("plausibility_source"),
            ),
        ).alias("distractors"),
        R.empty_texts(r("scope_tags")).alias("scope_tags"),
        r("out_of_scope_warning").alias("out_of_scope_warning"),
        R.default_text(r("stem_type"), "direct").alias("stem_type"),
        R.empty_texts(r("stem_constraints")).alias("stem_constraints"),
        F.lit(False).alias("is_fallback"),
    )


def fallback_plans(items: DataFrame, first_quotes: DataFrame, scope_tags: list[str]) -> DataFrame:
    """Placeholder plans for ``items(item_id, learning_target)`` whose reply could not be read.

    ``first_quotes(item_id, quote_id)`` holds each item's first quote.
    """
    # fixed values: the placeholder distractors
    rows = (
        ("[Distractor 1 - to be generated]", "unsafe", "approaches_hazard", "Approaches the hazard zone", "[hazard constraint]"),
        ("[Distractor 2 - to be generated]", "wrong_sequence", "wrong_sequence", "Correct action but wrong order", "[sequence constraint]"),
        ("[Distractor 3 - to be generated]", "out_of_scope", "exceeds_scope", "Beyond scope of practice", "[scope constraint]"),
    )
    names = ("text", "tag", "failure_reason", "why_wrong", "stem_fact_violated")
    distractors = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)], F.lit(None).cast("string").alias("plausibility_source"))
        for row in rows
    ])
    support = F.when(
        F.col("quote_id").isNotNull(),
        F.array(F.struct(F.col("quote_id"), F.lit("primary_support").alias("role"), F.lit("correct answer").alias("supports_claim"))),
    ).otherwise(_empty(SUPPORT))
    null = F.lit(None).cast("string")
    return items.select("item_id", "learning_target").join(first_quotes, "item_id", "left").select(
        "item_id", "learning_target",
        F.lit("factual").alias("question_type"),
        T.words_array([]).alias("hazard_cues"),
        null.alias("scenario_context"),
        _empty(LOCK).alias("decision_locks"),
        F.col("learning_target").alias("correct_action"),
        F.lit("[To be generated based on quotes]").alias("correct_option_text"),
        F.lit("Based on source material").alias("why_correct"),
        F.lit("[To be determined]").alias("discriminating_factor"),
        support.alias("support_mapping"),
        distractors.alias("distractors"),
        T.words_array(scope_tags[:2]).alias("scope_tags"),
        null.alias("out_of_scope_warning"),
        F.lit("direct").alias("stem_type"),
        T.words_array(["No double negatives", "Clear and concise"]).alias("stem_constraints"),
        F.lit(True).alias("is_fallback"),
    )


def plans_or_fallback(replies: DataFrame, first_quotes: DataFrame, scope_tags: list[str]) -> DataFrame:
    bad = replies.filter(~R.is_object("reply"))
    return ingest_plans(replies).unionByName(fallback_plans(bad, first_quotes, scope_tags))


def _open(value: ColumnLike) -> Column:
    """Empty or a bracketed placeholder."""
    value = F.coalesce(col(value), F.lit(""))
    return (value == "") | value.startswith("[")


def missing_supports(plans: DataFrame, quotes: DataFrame) -> DataFrame:
    """Support entries that name a quote the item does not have."""
    used = unnest(plans, "support_mapping", ["item_id"], "s", "support_pos")
    return used.select("item_id", "support_pos", "s.quote_id").join(
        quotes.select("item_id", "quote_id").distinct(), ["item_id", "quote_id"], "left_anti"
    )


def plan_issues(plans: DataFrame, quotes: DataFrame) -> DataFrame:
    """``plans`` plus ``issues``: every requirement the plan misses, in check order."""
    # the support entries of one plan are few
    unknown = missing_supports(plans, quotes).groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("support_pos", "quote_id"))).alias("u")
    )
    reasons = F.transform("distractors", lambda d: d["failure_reason"])
    issues = F.concat(
        T.array_of_issues((F.size("support_mapping") == 0, "no_support_mapping")),
        F.transform(
            F.coalesce("u", _empty("struct<support_pos:int,quote_id:string>")),
            lambda x: F.concat(F.lit("unknown_quote: "), x["quote_id"]),
        ),
        T.array_of_issues(
            (F.size("distractors") != 3, F.concat(F.lit("distractor_count: "), F.size("distractors"))),
            (
                F.col("question_type").isin(list(lex.LOCKED_QUESTION_TYPES)) & (F.size("decision_locks") == 0),
                "missing_decision_lock",
            ),
            (F.size(repeated(reasons)) > 0, F.concat(F.lit("shared_failure_reason: "), F.array_join(repeated(reasons), ", "))),
        ),
        F.transform(
            F.filter(
                F.transform("distractors", lambda d, i: F.struct(i.alias("i"), _open(d["stem_fact_violated"]).alias("open"))),
                lambda x: x["open"],
            ),
            lambda x: F.concat(F.lit("missing_stem_fact: "), x["i"] + 1),
        ),
        T.array_of_issues(
            (_open("discriminating_factor"), "missing_discriminating_factor"),
            (_open("correct_option_text"), "missing_correct_option"),
            (F.size("scope_tags") == 0, "no_scope_tags"),
        ),
    )
    return plans.join(unknown, "item_id", "left").withColumn("issues", issues).drop("u")


def plan_ambiguity_issues() -> Column:
    """Column over a plan row: uncovered distractors, missing plausibility, vague factor."""
    covered = F.transform(
        F.flatten(F.transform("decision_locks", lambda x: x["eliminates_options"])), F.lower
    )
    numbered = F.transform("distractors", lambda d, i: F.struct((i + 1).alias("n"), d.alias("d")))
    text = lambda x: F.lower(x["d"]["text"])
    uncovered = F.filter(
        numbered,
        lambda x: ~F.exists(covered, lambda c: text(x).contains(c) | c.contains(text(x))),
    )
    locked = F.col("question_type").isin(list(lex.LOCKED_QUESTION_TYPES))
    no_source = F.filter(numbered, lambda x: F.coalesce(x["d"]["plausibility_source"], F.lit("")) == "")
    low = F.lower("discriminating_factor")
    vague = F.get(F.filter(T.words_array(lex.PLAN_VAGUE_PHRASES), lambda p: low.contains(p)), F.lit(0))
    name = lambda what: lambda x: F.concat(F.lit(what), x["n"])
    return F.concat(
        F.when(locked, F.transform(uncovered, name("not_eliminated: "))).otherwise(T.words_array([])),
        F.transform(no_source, name("no_plausibility: ")),
        T.array_of_issues((vague.isNotNull(), F.concat(F.lit("vague_factor: "), vague))),
    )


def required_quote_ids(support: ColumnLike = "support_mapping") -> Column:
    return F.transform(
        F.filter(col(support), lambda s: s["role"] == "primary_support"), lambda s: s["quote_id"]
    )


# --- query plans --------------------------------------------------------------------------


def ingest_query_plans(replies: DataFrame) -> DataFrame:
    """``replies(item_id, learning_target, reply)`` -> one query plan row per readable reply."""
    rows = replies.filter(R.is_object("reply")).withColumn("r", R.read_as("reply", QUERY_REPLY))
    query = "struct<query_text:string,intent:string,must_include:array<string>,priority:int>"
    return rows.select(
        "item_id", "learning_target",
        F.transform(
            F.coalesce("r.queries", _empty(query)),
            lambda q: F.struct(
                R.default_text(q["query_text"]).alias("query_text"),
                R.one_of(q["intent"], lex.QUERY_INTENTS, "high_precision").alias("intent"),
                R.empty_texts(q["must_include"]).alias("must_include"),
                F.coalesce(q["priority"], F.lit(1)).alias("priority"),
            ),
        ).alias("queries"),
        R.empty_texts("r.must_include_keywords").alias("must_include_keywords"),
    )


def fallback_queries(items: DataFrame) -> DataFrame:
    """Four templated queries and three keywords for
    ``items(item_id, learning_target, topic_name, subtopic_name)``."""
    target = F.col("learning_target")
    query = lambda text, intent, priority: F.struct(
        text.alias("query_text"), F.lit(intent).alias("intent"),
        T.words_array([]).alias("must_include"), F.lit(priority).alias("priority"),
    )
    keywords = F.filter(
        T.find_all(F.lower(target), r"\w{4,}"), lambda w: ~w.isin(lex.QUERY_STOP_WORDS)
    )
    return items.select(
        "item_id", "learning_target",
        F.array(
            query(F.concat_ws(" ", "topic_name", "subtopic_name", target), "high_precision", 1),
            query(target, "high_precision", 1),
            query(F.concat(target, F.lit(" should must ensure")), "quote_hunt", 2),
            query(F.concat(F.col("subtopic_name"), F.lit(" procedures assessment")), "scenario_context", 2),
        ).alias("queries"),
        F.slice(keywords, 1, 3).alias("must_include_keywords"),
    )


def query_plans_or_fallback(replies: DataFrame) -> DataFrame:
    bad = replies.filter(~R.is_object("reply"))
    return ingest_query_plans(replies).unionByName(fallback_queries(bad))


def queries_by_intent(plans: DataFrame, *intents: str) -> DataFrame:
    """Query rows of the given intents, ordered by intent as listed, then plan position."""
    rank = F.array_position(T.words_array(intents), F.col("q.intent"))
    return (
        unnest(plans, "queries", ["item_id"], "q", "plan_pos")
        .filter(F.col("q.intent").isin(list(intents)))
        .select("item_id", rank.alias("intent_rank"), "plan_pos", "q.*")
    )


def precision_queries(plans: DataFrame) -> DataFrame:
    return queries_by_intent(plans, "high_precision")


def broadening_queries(plans: DataFrame) -> DataFrame:
    return queries_by_intent(plans, "synonym_variant", "scenario_context")
