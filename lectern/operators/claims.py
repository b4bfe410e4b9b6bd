"""Claims in explanations, matched against source chunks, and the item verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import lexicon as lex
from lectern.functions import text as T
from lectern.functions.text import ColumnLike, col
from lectern.operators.unnest import unnest_structs

PASS, REPAIR, REJECT = "pass", "repair", "reject"


def claims_of(explanation: ColumnLike) -> Column:
    """``array<struct<claim_pos, claim, claim_type, is_critical, source_sentence>>``."""

    def claim(pos, text, kind, critical, source) -> Column:
        return F.struct(
            pos.alias("pos"), text.alias("claim"), kind.alias("claim_type"),
            critical.alias("is_critical"), source.alias("source_sentence"),
        )

    def of_sentence(s: Column, pos: Column) -> Column:
        low = F.lower(s)
        kind = F.lit("factual")
        for name, pattern in lex.CLAIM_TYPE_PATTERNS:
            kind = F.when(T.matches(low, pattern), name).otherwise(kind)
        own = F.array(claim(pos, s, kind, T.matches(low, lex.CRITICAL_CLAIM_PATTERN), s))
        quoted = F.transform(
            F.regexp_extract_all(s, F.lit('"([^"]+)"'), F.lit(1)),
            lambda q: claim(pos, q, F.lit("factual"), F.lit(True), s),
        )
        return F.when(low.rlike("^the source states?"), quoted).otherwise(
            F.when(F.length(s) > 30, own).otherwise(F.slice(own, 1, 0))
        )

    found = F.flatten(F.transform(T.sentences(explanation, enders=".!"), of_sentence))
    return F.transform(
        found,
        lambda c, i: F.struct(
            i.alias("claim_pos"), c["claim"].alias("claim"), c["claim_type"].alias("claim_type"),
            c["is_critical"].alias("is_critical"), c["source_sentence"].alias("source_sentence"),
        ),
    )


def extract_claims(items: DataFrame) -> DataFrame:
    """One row per claim of ``items(item_id, explanation)``."""
    return unnest_structs(items, claims_of("explanation"), ["item_id"])


def is_allowed_inference(claim: ColumnLike) -> Column:
    return F.lower(col(claim)).rlike("|".join(lex.ALLOWED_INFERENCE_PATTERNS))


def match_claims(claims: DataFrame, links: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Best chunk per claim.

    ``claims(item_id, claim_pos, claim, ...)``, ``links(item_id, chunk_id, chunk_pos, text)``
    -> claims with ``status, matched_chunk_id, matched_text, confidence, repair_suggestion``.

    The claims of one explanation travel as one array, so a chunk's text is moved once per
    item that uses it. Per claim only the first chunk for each number of shared words is kept
    (a claim of n words has at most n + 1 of those), which is all the ordered scan of the
    chunks can depend on: groups stay small however many chunks an item has.
    """
    per_item = claims.groupBy("item_id").agg(
        F.collect_list(
            F.struct("claim_pos", F.lower("claim").alias("low"))
        ).alias("claims")  # the claims of one explanation
    )
    low = F.lower("text")
    # every claim meets every part, so the words of both are split before
    pairs = links.join(per_item, "item_id").select(
        "item_id", "chunk_id", "chunk_pos", low.alias("low"),
        F.transform("claims", lambda c: F.struct(c["claim_pos"], c["low"], F.array_distinct(T.split_words(c["low"])).alias("words"))).alias("claims"),
        F.array_distinct(T.split_words(low)).alias("chunk_words"),
        F.transform(F.split(low, r"\."), lambda p: F.struct(p.alias("text"), F.array_distinct(T.split_words(p)).alias("words"))).alias("parts"),
    )

    def scored(c: Column) -> Column:
        words = c["words"]
        size = F.greatest(F.size(words), F.lit(1))
        shared = F.size(F.array_intersect(words, F.col("chunk_words")))
        part = F.get(
            F.filter(
                "parts",
                lambda p: F.size(F.array_intersect(words, p["words"])) / size > 0.5,
            ),
            F.lit(0),
        )["text"]
        exact = F.col("low").contains(c["low"])
        return F.struct(
            c["claim_pos"].alias("claim_pos"),
            exact.alias("exact"),
            F.when(exact, F.lit(-1)).otherwise(shared).alias("shared"),
            (shared / size).alias("score"),
            F.when(~exact, T.strip(part)).alias("part"),
        )

    hits = (
        unnest_structs(pairs, F.transform("claims", scored), ["item_id", "chunk_id", "chunk_pos"])
        .groupBy("item_id", "claim_pos", "exact", "shared", "score")
        .agg(F.min_by(F.struct("chunk_pos", "chunk_id", "part"), "chunk_pos").alias("first"))
        .groupBy("item_id", "claim_pos")
        .agg(
            F.min(F.when(F.col("exact"), F.col("first"))).alias("exact"),
            F.array_sort(
                F.collect_list(
                    F.when(
                        ~F.col("exact") & (F.col("shared") > 0),
                        F.struct("first.chunk_pos", "score", "first.chunk_id", "first.part"),
                    )
                )
            ).alias("seen"),
        )
    )
    start = F.struct(
        F.lit(0.0).alias("score"), F.lit(None).cast(dict(links.dtypes)["chunk_id"]).alias("chunk_id"),
        F.lit(None).cast("string").alias("part"),
    )
    best = F.aggregate(
        "seen",
        start,
        lambda acc, x: F.when(
            x["score"] > acc["score"],
            F.struct(
                x["score"].alias("score"), x["chunk_id"].alias("chunk_id"),
                F.coalesce(x["part"], acc["part"]).alias("part"),
            ),
        ).otherwise(acc),
    )
    out = claims.join(
        hits.select("item_id", "claim_pos", "exact", best.alias("best")),
        ["item_id", "claim_pos"], "left",
    )
    is_exact = F.col("exact").isNotNull()
    score = F.when(is_exact, 1.0).otherwise(F.coalesce("best.score", F.lit(0.0)))
    status = F.when(score >= 0.8, PASS).when(score >= threshold, REPAIR).otherwise(REJECT)
    matched = status != REJECT
    part = F.when(is_exact, F.col("claim")).when(matched, F.col("best.part"))
    return out.select(
        *claims.columns,
        status.alias("status"),
        F.when(is_exact, F.col("exact.chunk_id"))
        .when(matched, F.col("best.chunk_id")).alias("matched_chunk_id"),
        part.alias("matched_text"),
        score.alias("confidence"),
        F.when(
            status == REPAIR,
            F.concat(F.lit("Adjust wording to match: '"), F.substring(part, 1, 100), F.lit("...'")),
        ).alias("repair_suggestion"),
    )


def admission_phrase(explanation: ColumnLike) -> Column:
    """First listed phrase by which the text admits that its source is silent, or null."""
    low = F.lower(col(explanation))
    hit = F.lit(None).cast("string")
    for phrase in reversed(lex.SOURCE_ADMISSIONS):
        hit = F.when(low.contains(phrase), phrase).otherwise(hit)
    return hit


def answer_keywords(answer: ColumnLike) -> Column:
    words = F.filter(
        T.split_words(F.lower(col(answer))),
        lambda w: (F.length(w) > 3) & ~w.isin([s for s in lex.ANSWER_STOP_WORDS if len(s) > 3]),
    )
    return F.transform(words, lambda w: F.btrim(w, F.lit(".,!?()[]\"'")))


def unsupported_details(explanation: ColumnLike) -> Column:
    """Details that must stand in the source: ``array<struct<kind, detail>>`` in check order."""
    low = F.lower(col(explanation))

    def found(kind: str, pattern: str) -> Column:
        return F.transform(
            T.find_all(low, pattern, 1), lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("detail"))
        )

    parts = [found(kind, pattern) for kind, pattern in lex.SENSORY_PATTERNS]
    parts += [found("measurement", pattern) for pattern in lex.MEASUREMENT_PATTERNS]
    return F.concat(*parts)


def inference_admissions(explanation: ColumnLike) -> Column:
    low = F.lower(col(explanation))
    return F.filter(T.words_array(lex.INFERENCE_ADMISSIONS), lambda p: low.contains(p))


def check_items_against_source(items: DataFrame, links: DataFrame) -> DataFrame:
    """Which answer keywords and details stand in the item's chunks.

    ``items(item_id, explanation, correct_answer)``. Each needle is tested per chunk and
    combined with ``bool_or``, so no item's chunks are ever joined into one text.
    """
    wanted = F.concat(
        F.transform(
            answer_keywords("correct_answer"),
            lambda k: F.struct(F.lit("keyword").alias("kind"), k.alias("detail")),
        ),
        unsupported_details("explanation"),
    )
    needles = unnest_structs(items, wanted, ["item_id"], "needle_pos")
    per_item = needles.groupBy("item_id").agg(
        F.collect_list(F.struct("needle_pos", "kind", "detail")).alias("needles")  # one text's
    )
    hits = F.transform(
        "needles",
        lambda n: F.struct(n["needle_pos"].alias("needle_pos"), F.col("low").contains(n["detail"]).alias("hit")),
    )
    tested = (
        unnest_structs(links.join(per_item, "item_id").withColumn("low", F.lower("text")), hits, ["item_id"])
        .groupBy("item_id", "needle_pos")
        .agg(F.bool_or("hit").alias("hit"))
    )
    judged = needles.join(tested, ["item_id", "needle_pos"], "left").groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("needle_pos", "kind", "detail", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("n")
    )
    pick = lambda test: F.transform(F.filter("n", test), lambda x: x["detail"])
    return (
        items.select("item_id", "explanation")
        .join(judged, "item_id", "left")
        .withColumn("n", F.coalesce("n", F.expr("filter(array(named_struct('needle_pos', 0, 'kind', '', 'detail', '', 'hit', false)), x -> false)")))
        .select(
            "item_id",
            pick(lambda x: (x["kind"] == "keyword") & x["hit"]).alias("matched_keywords"),
            pick(lambda x: (x["kind"] == "keyword") & ~x["hit"]).alias("missing_keywords"),
            F.slice(
                F.concat(
                    pick(lambda x: (x["kind"] != "keyword") & ~x["hit"]),
                    inference_admissions("explanation"),
                ),
                1, 5,
            ).alias("unsupported"),
        )
        .withColumn(
            "is_supported",
            F.size("matched_keywords")
            >= F.least(F.lit(2), F.size("matched_keywords") + F.size("missing_keywords")),
        )
    )


def verify_items(
    items: DataFrame, links: DataFrame, mode: str = "balanced", threshold: float = 0.6
) -> DataFrame:
    """PASS / REPAIR / REJECT per item with counts and reason.

    ``items(item_id, explanation, correct_answer)``; a null answer skips the answer gate.
    """
    if mode not in ("balanced", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    source = check_items_against_source(items, links)
    has_chunks = links.groupBy("item_id").agg(F.lit(True).alias("has_chunks"))
    matched = match_claims(extract_claims(items), links, threshold)
    lifted = F.lit(False)
    if mode == "balanced":
        lifted = (
            (F.col("status") == REJECT)
            & is_allowed_inference("claim")
            & (
                (F.col("claim_type") == "distractor")
                | ((F.col("claim_type") == "rationale") & ~F.col("is_critical"))
            )
        )
    final = F.when(lifted, PASS).otherwise(F.col("status"))
    counts = matched.withColumn("lifted", lifted).withColumn("final", final).groupBy("item_id").agg(
        F.count_if(F.col("final") == PASS).alias("pass_count"),
        F.count_if(F.col("final") == REPAIR).alias("repair_count"),
        F.count_if(F.col("final") == REJECT).alias("reject_count"),
        F.count_if("lifted").alias("inference_count"),
        F.array_sort(
            F.collect_list(
                F.when(
                    (F.col("final") == REJECT) & F.col("is_critical"),
                    F.struct("claim_pos", F.substring("claim", 1, 50).alias("claim")),
                )
            )
        ).alias("critical"),
    )
    joined = (
        items.select("item_id", "explanation", "correct_answer")
        .join(source, "item_id", "left")
        .join(has_chunks, "item_id", "left")
        .join(counts, "item_id", "left")
        .fillna(0, ["pass_count", "repair_count", "reject_count", "inference_count"])
    )
    answer_open = F.col("correct_answer").isNotNull() & (
        (F.col("correct_answer") == "") | F.col("has_chunks").isNull() | ~F.col("is_supported")
    )
    critical = F.coalesce(F.size("critical"), F.lit(0)) > 0
    strict = F.lit(mode == "strict")
    gate = (
        F.when(F.coalesce("explanation", F.lit("")) == "", "no_explanation")
        .when(admission_phrase("explanation").isNotNull(), "admission")
        .when(answer_open, "answer_not_supported")
        .when(strict & (F.size("unsupported") > 0), "unsupported_details")
        .when(critical, "critical_claims")
        .when(strict & (F.col("reject_count") > F.col("pass_count")), "too_many_unverified")
    )
    if mode == "strict":
        needs_repair = F.col("repair_count") > 0
    else:
        needs_repair = (F.col("repair_count") > F.col("pass_count")) & (
            F.col("reject_count") > F.col("inference_count")
        )
    gated = joined.withColumn("rejection_reason", gate)
    early = F.col("rejection_reason").isin(
        "no_explanation", "admission", "answer_not_supported", "unsupported_details"
    )
    zero = lambda c: F.when(F.coalesce(early, F.lit(False)), 0).otherwise(F.col(c)).alias(c)
    return gated.select(
        "item_id",
        F.when(F.col("rejection_reason").isNotNull(), REJECT)
        .when(needs_repair, REPAIR).otherwise(PASS).alias("status"),
        zero("pass_count"), zero("repair_count"), zero("reject_count"),
        "rejection_reason",
        F.when(
            ~F.coalesce(early, F.lit(False)),
            F.transform(F.coalesce("critical", F.slice("critical", 1, 0)), lambda c: c["claim"]),
        ).alias("critical_failures"),
    )


def repair_list(matched: DataFrame) -> DataFrame:
    """Claims to reword, with suggestion and source text."""
    return matched.filter(
        (F.col("status") == REPAIR) & F.col("repair_suggestion").isNotNull()
    ).select(
        "item_id", "claim_pos", F.substring("claim", 1, 100).alias("claim"),
        F.col("repair_suggestion").alias("suggestion"), F.col("matched_text").alias("source_text"),
    )
