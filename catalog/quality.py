"""Queries over gates, scores, novelty and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    ALLOWED_TAGS, SQL_ITEMS, items, plain, sql_has, sql_jaccard, sql_list, sql_long_words, sql_strip, sql_terms, sql_words, table,
)
from lectern.functions import lexicon as lex
from lectern.functions import text as T
from lectern.operators import ambiguity as B
from lectern.operators import distractors as D
from lectern.operators import gates as G
from lectern.operators import metrics as M
from lectern.operators import novelty as N
from lectern.operators import repair as R
from lectern.operators import scoring as S

# --- the gates in SQL -----------------------------------------------------------------------

_ALIGN = sql_list(lex.ALIGNMENT_STOP_WORDS)
_OPPOSED = " OR ".join(f"({sql_has('low', a)} AND {sql_has('low', b)})" for a, b in lex.EXPLANATION_OPPOSITES)
_CONTRA = " + ".join(
    f"({sql_has('answer', a)} AND {sql_has('low', b)} AND topic)::INT" for a, b in lex.ANSWER_OPPOSITES
)
_SHIFT = " + ".join(
    f"(contains(low_stem, '{w}') AND NOT contains(low_target, '{w}') AND NOT contains(low_target, '{c}'))::INT" for w, c in lex.TOPIC_CATEGORIES.items()
)
_NEGATIONS = " + ".join(f"{sql_has('low_stem', w)}::INT" for w in lex.STEM_NEGATIONS)
_FIRST3 = lambda x: f"{sql_words(f'lower({x})')}[1:3]"

SQL_GATES = f"""
{SQL_ITEMS},
prep AS (
  SELECT *, lower(explanation) AS low, lower(stem) AS low_stem, lower(correct_answer) AS answer, lower(learning_target) AS low_target,
    {sql_long_words('stem')} AS stem_words, {sql_long_words('correct_answer')} AS answer_words,
    list_filter({sql_long_words('learning_target')}, lambda z: NOT list_contains({_ALIGN}, z)) AS wanted,
    CASE WHEN ends_with({sql_strip('lower(stem)')}, ' an') THEN 'an' WHEN ends_with({sql_strip('lower(stem)')}, ' a') THEN 'a' END AS article,
    list_transform(list_concat([correct_answer], distractors), lambda z: {sql_strip("regexp_replace(lower(z), '[^" + chr(92) + "p{L}" + chr(92) + "p{N}_" + chr(92) + "s]', '', 'g')")}) AS plain
  FROM items),
base AS (
  SELECT *, len(list_filter(answer_words, lambda z: contains(low, z))) > 0 AS topic,
    coalesce(article IS NOT NULL AND (article = 'an') = (left({sql_strip('answer')}, 1) IN ('a', 'e', 'i', 'o', 'u'))
      AND len(list_filter(distractors, lambda z: {sql_strip('z')} <> '' AND (article = 'an') = (left({sql_strip('lower(z)')}, 1) IN ('a', 'e', 'i', 'o', 'u')))) = 0, false)::INT
    + len(list_filter(distractors, lambda z: len(list_intersect(stem_words, list_filter(answer_words, lambda w: NOT list_contains({sql_long_words('z')}, w)))) > 1))
    + ({_NEGATIONS} > 1)::INT AS leak,
    len(list_filter(scope_tags, lambda z: NOT list_contains({sql_list(ALLOWED_TAGS)}, z))) AS outside,
    (SELECT count(*) FROM unnest(range(len(plain))) AS i(i), unnest(range(len(plain))) AS j(j) WHERE i < j AND plain[i + 1] = plain[j + 1])
    + regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])(also (?:correct|valid|acceptable)|could also be|another valid|either .+ or .+ (?:is|are) correct)($|[^\\p{{L}}\\p{{N}}_])')::INT
    + ({_OPPOSED})::INT AS several,
    len(wanted) AS n_wanted, len(list_intersect(wanted, {sql_long_words("low_stem || ' ' || answer")})) AS in_stem, len(list_intersect(wanted, {sql_long_words('low')})) AS in_text
  FROM prep),
gate AS (
  SELECT *,
    {_CONTRA} + ({sql_has('low_stem', 'never')} AND {sql_has('low', 'always')})::INT + ({sql_has('low_stem', 'always')} AND {sql_has('low', 'never')})::INT
    + ((regexp_matches(low, 'first.{{0,50}}assess') AND regexp_matches(low, 'first.{{0,50}}treat')) OR (regexp_matches(low, 'before.{{0,50}}(calling|contact)') AND regexp_matches(low, 'immediately.{{0,50}}(call|contact)')))::INT
    + (regexp_matches(low, '(?:however|but|although).{{0,100}}(?:should not|must not|never|incorrect)') AND {sql_has('low[1:100]', 'should|must|always')})::INT AS contra,
    CASE WHEN n_wanted < 2 THEN 0 ELSE (in_stem::DOUBLE / n_wanted < 0.25)::INT + (in_text::DOUBLE / n_wanted < 0.2)::INT + {_SHIFT}
      + ((regexp_matches(low_stem, '(^|[^\\p{{L}}\\p{{N}}_])first($|[^\\p{{L}}\\p{{N}}_]).*(action|step|thing)') OR {sql_has('low_stem', 'priority')})
         AND NOT (contains(low_target, 'first') OR contains(low_target, 'priority') OR contains(low_target, 'initial') OR contains(low_target, 'before') OR contains(low_target, 'sequence')))::INT END AS drift,
    list_sum(list_transform(distractors, lambda z: (length({sql_strip('z')}) < 5)::INT + (contains(lower(z), 'all of the above') OR contains(lower(z), 'none of the above') OR contains(lower(z), 'both a and b'))::INT
      + (length(z) > 10 AND length(correct_answer) > 10 AND {_FIRST3('z')} = {_FIRST3('correct_answer')} AND len({_FIRST3('z')}) >= 2)::INT)) AS weak,
    {sql_long_words('answer', 5)} AS long_answer, {sql_long_words('low', 5)} AS long_text, len({sql_words('explanation')}) AS n_words,
    (right({sql_strip('stem')}, 1) NOT IN ('?', ':', '.'))::INT + {sql_has('low', 'gonna|wanna|gotta|kinda|sorta|yeah|yep|nope|ok|okay|lol')}::INT + regexp_matches(explanation, '[\\x{{1F300}}-\\x{{1F9FF}}]')::INT AS style
  FROM base),
flag AS (
  SELECT item_id, learning_target, difficulty, leak = 0 AS g_leak, outside = 0 AS g_scope, several = 0 AS g_single, contra = 0 AS g_contra, drift = 0 AS g_align,
    coalesce(weak, 0) = 0 AS g_distractor, difficulty = 'medium' AS g_difficulty,
    NOT (len(long_answer) > 0 AND len(list_intersect(long_answer, long_text))::DOUBLE / greatest(len(long_answer), 1) < 0.3) AS g_ground,
    n_words BETWEEN 20 AND 150 AS g_words, style = 0 AS g_style, coalesce(weak, 0) AS weak FROM gate)
"""

SQL_CHECKS = f"""
{SQL_GATES},
check_row AS (
  SELECT item_id, unnest(['stem_answer_consistency', 'scope_legality', 'single_best_answer', 'internal_consistency', 'learning_target_alignment',
                          'distractor_quality', 'difficulty_alignment', 'decision_grounding', 'verbosity', 'style']) AS gate_name,
         unnest([g_leak, g_scope, g_single, g_contra, g_align, g_distractor, g_difficulty, g_ground, g_words, g_style]) AS ok,
         unnest([1, 1, 1, 1, 1, 2, 2, 2, 3, 3]) AS tier, learning_target FROM flag)
"""


def _gated(spark, sf_dir):
    return G.run_gates(items(spark, sf_dir), ALLOWED_TAGS)


def gates_long(spark, sf_dir):
    return plain(G.gates_long(_gated(spark, sf_dir)).select("item_id", "gate_name", "tier", "result"))


def gate_report(spark, sf_dir):
    report = G.gate_report(_gated(spark, sf_dir))
    return plain(report.select("item_id", "tier_1_passed", "tier_2_passed", "overall_pass", "requires_repair", "tier_3_flags", "repair_targets", F.array_sort(F.map_keys("repair_hints")).alias("hinted"), R.can_repair().alias("can_repair")))


def _scored(spark, sf_dir):
    """Quote counts stand in from the item's number, so every branch of the score is taken."""
    n = F.col("item_id")
    counted = G.gate_report(_gated(spark, sf_dir)).withColumn("required_count", (n % 4).cast("int")).withColumn("exact_match_count", F.least(n % 3, n % 4).cast("int")).withColumn(
        "fuzzy_match_count", F.when((n % 4 == 3) & (n % 3 == 0), 1).otherwise(0)
    ).withColumn("missing_quote_ids", F.when(n % 8 == 3, T.words_array(["Q3"])).otherwise(T.words_array([])))
    return S.quality_score(counted)


def composite_score(spark, sf_dir):
    return plain(_scored(spark, sf_dir).select("item_id", "grounding", "consistency", "scope", "distractor_score", "novelty_score", "composite_score", "decision", "flags"))


SQL_SCORE = f"""
{SQL_GATES},
dim AS (
  SELECT *, g_leak AND g_scope AND g_single AND g_contra AND (g_align OR learning_target = '') AS t1, g_distractor AND g_difficulty AND g_ground AS t2,
    CASE WHEN item_id % 4 = 0 THEN 0.5 ELSE least(greatest(least((least(item_id % 3, item_id % 4) + f)::DOUBLE, 1.0)
      + CASE WHEN least(item_id % 3, item_id % 4) + f > 0 THEN least(item_id % 3, item_id % 4)::DOUBLE / (least(item_id % 3, item_id % 4) + f) * 0.2 ELSE 0 END
      - CASE WHEN item_id % 8 = 3 THEN 0.2 ELSE 0 END, 0.0), 1.0) END::DOUBLE AS grounding,
    (g_leak::INT + g_single::INT) / 2.0::DOUBLE AS consistency, g_scope::INT::DOUBLE AS scope,
    CASE WHEN g_distractor THEN 1.0 ELSE greatest(1.0 - least(weak * 0.25, 0.75), 0.25) END::DOUBLE AS distractor_score, 1.0::DOUBLE AS novelty_score
  FROM (SELECT *, CASE WHEN item_id % 4 = 3 AND item_id % 3 = 0 THEN 1 ELSE 0 END AS f FROM flag)),
total AS (SELECT *, grounding * 0.30::DOUBLE + consistency * 0.25::DOUBLE + scope * 0.15::DOUBLE + distractor_score * 0.20::DOUBLE + novelty_score * 0.10::DOUBLE AS composite FROM dim),
verdict AS (
  SELECT *, CASE WHEN NOT t1 THEN 'reject' WHEN composite >= 0.8 THEN 'accept' WHEN composite >= 0.65 THEN 'accept_with_flags' WHEN NOT t2 THEN 'repair' ELSE 'reject' END AS decision,
    list_concat(list_filter([CASE WHEN NOT g_words THEN 'verbosity' END, CASE WHEN NOT g_style THEN 'style' END], lambda z: z IS NOT NULL),
      list_filter(list_transform([{{'n': 'grounding', 's': grounding}}, {{'n': 'consistency', 's': consistency}}, {{'n': 'scope', 's': scope}}, {{'n': 'distractors', 's': distractor_score}}, {{'n': 'novelty', 's': novelty_score}}],
        lambda d: CASE WHEN d.s < 0.5 THEN 'low_' || d.n WHEN d.s < 0.7 THEN 'borderline_' || d.n END), lambda z: z IS NOT NULL)) AS flags
  FROM total)
"""


def score_again(spark, sf_dir):
    """Second scores after a repair that changed nothing: below the flag threshold is out."""
    again = S.score_after_repair(_scored(spark, sf_dir))
    return plain(again.groupBy("decision", F.array_contains("flags", "failed_after_repair").alias("failed")).agg(F.count(F.lit(1)).alias("items")))


def improvement_suggestions(spark, sf_dir):
    return plain(S.improvement_suggestions(_scored(spark, sf_dir)).groupBy("dimension", "suggestion").agg(F.count(F.lit(1)).alias("items")))


def score_reports(spark, sf_dir):
    text = S.score_report(_scored(spark, sf_dir))
    lines = F.split("report", "\n")
    return plain(text.select("item_id", F.size(lines).alias("lines"), F.get(lines, F.lit(2)).alias("decision_line"), F.get(lines, F.lit(3)).alias("first_dimension")))


def repair_routing(spark, sf_dir):
    routed = R.route_repairs(_gated(spark, sf_dir))
    return plain(routed.select("item_id", "gate_name", F.coalesce("repair_type", F.lit("")).alias("repair_type"), F.coalesce("attempt", F.lit(0)).alias("attempt"), F.coalesce("remaining_issue", F.lit("")).alias("remaining_issue")))


def repairs_applied(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("missing_quote_ids", T.words_array(["Q1"]))
    routed = R.route_repairs(G.run_gates(rows, ALLOWED_TAGS))
    text = F.when(F.col("item_id") % 2 == 0, "Because of [Q1] this holds.").otherwise("No quote at all.")
    wrong = F.when(F.col("item_id") % 3 > 0, F.to_json(T.words_array(["first wrong way", "second wrong way", "third wrong way"]))).otherwise('{"not": "a list"}')
    asked = routed.filter("repair_type is not null")
    replies = asked.select("item_id", "repair_type", "attempt", F.when(F.col("repair_type") == "explanation", text).otherwise(wrong).alias("reply"))
    done = R.apply_repairs(rows, routed, replies)
    return plain(done.select("item_id", "repairs_attempted", "fully_repaired", "remaining_issues", F.md5("explanation").alias("text_digest"), F.md5(F.array_join("distractors", "|")).alias("wrong_digest")))


def option_rewrites(spark, sf_dir):
    rows = items(spark, sf_dir)
    return plain(rows.select("item_id", R.option_accepted(F.col("stem"), "correct_answer", "learning_target").alias("option_ok"), R.stem_accepted("stem", "correct_answer").alias("stem_ok")))


# --- options ------------------------------------------------------------------------------------


def _options(spark, sf_dir):
    """Four options: the quarters of every document, the last with what is left over; empty ones too."""
    words = T.split_words(F.coalesce("text", F.lit("")))
    quarter = F.floor(F.size("w") / 4).cast("int")
    options = F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.array_join(F.slice("w", i * quarter + 1, F.when(i < 3, quarter).otherwise(F.size("w"))), " "))
    return table(spark, sf_dir, "documents").withColumn("w", words).select(
        F.col("doc_id").alias("item_id"), options.alias("options"), (F.col("doc_id") % 4).cast("int").alias("correct_index"),
        F.element_at(F.array(F.lit("beginner"), F.lit("intermediate"), F.lit("advanced")), (F.col("doc_id") % 3 + 1).cast("int")).alias("difficulty"),
    )


# an empty option has no words, so none in common
SQL_OPTIONS = f"""
w AS (SELECT doc_id AS item_id, {sql_words("coalesce(text, '')")} AS w FROM documents),
opt AS (SELECT item_id, [array_to_string(w[1:len(w) // 4], ' '), array_to_string(w[len(w) // 4 + 1:len(w) // 4 * 2], ' '), array_to_string(w[len(w) // 4 * 2 + 1:len(w) // 4 * 3], ' '), array_to_string(w[len(w) // 4 * 3 + 1:], ' ')] AS o,
          item_id % 4 AS correct, ['beginner', 'intermediate', 'advanced'][(item_id % 3 + 1)::INT] AS difficulty FROM w),
similar_pair AS (
  SELECT item_id, i, j, i = correct OR j = correct AS has_answer FROM opt, unnest(range(4)) AS a(i), unnest(range(4)) AS b(j)
  WHERE i < j AND len(list_intersect(list_distinct({sql_words("lower(o[i + 1])")}), list_distinct({sql_words("lower(o[j + 1])")})))::DOUBLE
    / greatest(1, len(list_distinct({sql_words("lower(o[i + 1] || ' ' || o[j + 1])")}))) > 0.7)
"""


def quick_ambiguity(spark, sf_dir):
    return plain(B.quick_verdict(_options(spark, sf_dir)).drop("reasoning"))


def distractor_review(spark, sf_dir):
    rows = _options(spark, sf_dir)
    return plain(rows.select("item_id", F.size(D.review_issues("options", "correct_index", "difficulty")).alias("issues")))


def distractor_balance(spark, sf_dir):
    n = F.col("doc_id")
    pick = lambda k: F.element_at(T.words_array(lex.WRONGNESS_PATTERNS), ((n * k) % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.array(pick(1), pick(3), pick(7)).alias("patterns"),
        F.element_at(F.array(F.lit("beginner"), F.lit("intermediate"), F.lit("advanced"), F.lit("other")), (n % 4 + 1).cast("int")).alias("difficulty"),
    )
    return plain(rows.select("doc_id", F.array_join(D.balance_issues("patterns", "difficulty"), "; ").alias("issues")))


_RULES = {k: v for k, v in lex.DISTRACTOR_RULES.items()}
_PICK = "list_transform([1, 3, 7], lambda k: {p}[((doc_id * k) % 8 + 1)::INT])".format(p=sql_list(lex.WRONGNESS_PATTERNS))


def pattern_suggestions(spark, sf_dir):
    """The first half of a text answers, the second asks."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.element_at(T.words_array(["assess it ", "wait ", "secure the scene ", "position "]), (F.col("doc_id") % 4 + 1).cast("int")), F.substr("text", F.lit(1), half)).alias("answer"),
        F.substr("text", half + 1).alias("stem"),
        F.element_at(T.words_array(["beginner", "intermediate", "advanced"]), (F.col("doc_id") % 3 + 1).cast("int")).alias("difficulty"),
    )
    found = D.suggest_patterns("answer", "stem", "difficulty")
    return plain(rows.select("doc_id", F.transform(found, lambda s: s["pattern"]).alias("patterns")))


# --- novelty ----------------------------------------------------------------------------------------


def _concepts(spark, sf_dir):
    """Every document as a concept: its text is the target, language and source the tag."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("doc_id").alias("pos"), F.concat_ws(" ", "lang", "source").alias("concept_tag"), F.col("text").alias("learning_target"), "source",
    )


SQL_CONCEPTS = f"""
concept AS (
  SELECT doc_id AS pos, lang || '_' || source AS tag, lang, source,
    list_sort(list_distinct(list_filter({sql_terms("coalesce(text, '')", lex.CONCEPT_STOP_WORDS)}, lambda z: NOT regexp_full_match(z, '[0-9]+')))) AS terms
  FROM documents),
word AS (SELECT pos, unnest(terms) AS w FROM concept),
tags AS (SELECT DISTINCT tag FROM concept),
tag_pair AS (SELECT a.tag AS a, b.tag AS b, CASE WHEN a.tag = b.tag THEN 1.0::DOUBLE ELSE {sql_jaccard("string_split(a.tag, '_')", "string_split(b.tag, '_')")} END AS alike FROM tags a, tags b)
"""


def novelty_check(spark, sf_dir):
    """Documents of odd number against those of even number as the registry."""
    signed = N.signatures(_concepts(spark, sf_dir))
    checked = N.check_novelty(signed.filter("pos % 2 = 1"), signed.filter("pos % 2 = 0"), 0.7)
    return plain(checked.select("pos", "is_novel", "similarity_score", F.coalesce("similar_tag", F.lit("")).alias("similar_tag"), "similar_terms"))


def _vector_concepts(spark, sf_dir):
    """Every vector as a concept; most pairs have neither word nor tag in common."""
    n = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(
        n.alias("pos"), F.concat(F.lit("group"), n % 397).alias("concept_tag"), F.concat(F.lit("topic"), n % 389).alias("learning_target"), "embedding",
    )
    return N.signatures(rows)


def novelty_vectors(spark, sf_dir):
    """Vectors of odd number against those of even number; a cosine of 0.32 suffices alone."""
    signed = _vector_concepts(spark, sf_dir)
    checked = N.check_novelty(signed.filter("pos % 2 = 1"), signed.filter("pos % 2 = 0"), 0.16, vectors=True)
    return plain(checked.select("pos", "is_novel", "similarity_score", F.coalesce("similar_tag", F.lit("")).alias("similar_tag"), "similar_terms"))


def greedy_dedup(spark, sf_dir):
    return plain(N.greedy_dedup(_concepts(spark, sf_dir), 0.85).select("item_id", "is_duplicate", F.coalesce("duplicate_of", F.lit("")).alias("duplicate_of"), "similarity_score"))


# the greedy walk in SQL: all similar pairs, then one kept/duplicate decision per position in order
SQL_GREEDY = f"""
WITH RECURSIVE {SQL_CONCEPTS},
shared AS (SELECT b.pos AS later, a.pos AS earlier, count(*) AS k FROM word a JOIN word b ON a.w = b.w AND a.pos < b.pos GROUP BY ALL),
pair AS (
  SELECT later, earlier, a.tag, alike * 0.4::DOUBLE + (k::DOUBLE / (len(a.terms) + len(b.terms) - k)) * 0.6::DOUBLE AS sim
  FROM shared JOIN concept a ON a.pos = earlier JOIN concept b ON b.pos = later JOIN tag_pair t ON t.a = a.tag AND t.b = b.tag),
edge AS (SELECT * FROM pair WHERE sim >= 0.85),
node AS (SELECT DISTINCT later AS pos FROM edge),
walk AS (
  SELECT -1::BIGINT AS pos, []::BIGINT[] AS dups
  UNION ALL
  SELECT n.pos, CASE WHEN len(list_filter((SELECT list(earlier) FROM edge e WHERE e.later = n.pos), lambda z: NOT list_contains(w.dups, z))) > 0 THEN list_append(w.dups, n.pos) ELSE w.dups END
  FROM walk w JOIN node n ON n.pos = (SELECT min(pos) FROM node m WHERE m.pos > w.pos)),
final AS (SELECT unnest(dups) AS pos FROM walk WHERE pos = (SELECT max(pos) FROM walk)),
best AS (
  SELECT e.later, arg_max(e.tag, e.sim * 1e6 - e.earlier * 1e-6) AS tag, max(e.sim) AS sim
  FROM edge e JOIN final f ON f.pos = e.later WHERE e.earlier NOT IN (SELECT pos FROM final) GROUP BY 1)
SELECT c.pos AS item_id, b.later IS NOT NULL AS is_duplicate, coalesce(b.tag, '') AS duplicate_of, round(b.sim, 6) AS similarity_score
FROM concept c LEFT JOIN best b ON b.later = c.pos
"""


def soft_novelty(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("doc_id").alias("pos"), F.col("text").alias("stem"), F.col("lang").alias("correct_answer")
    )
    return plain(N.soft_novelty(rows, 0.6).select("item_id", "similar_item_id", "similarity"))


# --- metrics --------------------------------------------------------------------------------------------


def _records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    rows = docs.select(
        F.col("source").alias("capsule_id"), n.alias("item_pos"), n.alias("item_id"),
        F.when(n % 5 > 0, F.col("lang")).alias("difficulty"), F.when(n % 7 > 0, "success").otherwise("").alias("generation_status"),
        F.when(n % 3 > 0, T.words_array(["c"])).otherwise(T.words_array([])).alias("chunk_ids"), F.array(n % 2 == 0, n % 3 == 0).alias("quotes_found"),
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_pos"), "quality", "toxic")
    where = docs.select(F.col("source").alias("capsule_id"), n.alias("item_pos"))
    judged = where.join(labels, "item_pos")
    verdicts = judged.select("capsule_id", "item_pos", F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "repair").otherwise("pass").alias("status"))
    novelty = judged.select("capsule_id", "item_pos", (F.col("quality") == 1).alias("is_novel"), F.lit("t").alias("similar_tag"))
    return M.item_records(rows, verdicts, novelty)


SQL_RECORDS = """
record AS (
  SELECT d.source AS capsule_id, d.doc_id AS item_id, d.doc_id % 3 > 0 AS evidence, (d.doc_id % 2 = 0)::INT + (d.doc_id % 3 = 0)::INT AS verified,
    l.doc_id IS NOT NULL AS checked, coalesce(l.quality = 1, true) AS novel, coalesce(l.toxic = 1, false) AS rejected, coalesce(l.toxic = 0 AND l.quality = 0, false) AS repaired,
    CASE WHEN d.doc_id % 5 > 0 THEN d.lang ELSE 'intermediate' END AS difficulty
  FROM documents d LEFT JOIN labels l USING (doc_id))
"""
_METRICS = """
count(*) AS total_items, count(*) FILTER (evidence) AS items_with_evidence, (2 * count(*))::BIGINT AS total_quotes, sum(verified)::BIGINT AS verified_quotes,
0::BIGINT AS items_checked_ambiguity, 0::BIGINT AS items_clear_answer, count(*) FILTER (checked) AS items_checked_novelty, count(*) FILTER (checked AND novel) AS items_novel,
count(*) FILTER (checked AND NOT novel) AS items_duplicate, count(*) FILTER (NOT rejected AND NOT repaired) AS items_passed_first, count(*) FILTER (repaired) AS items_repaired,
count(*) FILTER (rejected) AS items_rejected, round(count(*) FILTER (evidence) / count(*), 4) AS evidence_coverage_ratio, round(sum(verified) / (2 * count(*)), 4) AS quote_verification_rate,
0::DOUBLE AS single_answer_rate, round(CASE WHEN count(*) FILTER (checked) > 0 THEN count(*) FILTER (checked AND NOT novel) / count(*) FILTER (checked) ELSE 0 END, 4)::DOUBLE AS duplicate_concept_rate,
round(count(*) FILTER (repaired) / count(*), 4) AS repair_loop_rate, round(count(*) FILTER (rejected) / count(*), 4) AS rejection_rate
"""


def quality_metrics(spark, sf_dir):
    return plain(M.quality_metrics(_records(spark, sf_dir)))


def capsule_metrics(spark, sf_dir):
    return plain(M.capsule_metrics(_records(spark, sf_dir)))


def difficulty_distribution(spark, sf_dir):
    return plain(M.distribution(_records(spark, sf_dir), "difficulty"))


def metrics_text(spark, sf_dir):
    return plain(M.metrics_report(M.capsule_metrics(_records(spark, sf_dir))).select("capsule_id", "report"))


QUERIES = {
    "gates_long": (gates_long, f"""
WITH {SQL_CHECKS} SELECT item_id, gate_name, ['tier_1_hard', 'tier_2_repair', 'tier_3_soft'][tier] AS tier,
  CASE WHEN ok THEN 'pass' WHEN tier = 3 THEN 'warn' ELSE 'fail' END AS result FROM check_row WHERE gate_name <> 'learning_target_alignment' OR learning_target <> ''"""),
    "gate_report": (gate_report, f"""
WITH {SQL_GATES},
t AS (SELECT *, g_leak AND g_scope AND g_single AND g_contra AND (g_align OR learning_target = '') AS t1, g_distractor AND g_difficulty AND g_ground AS t2,
  coalesce(array_to_string(list_filter([CASE WHEN NOT g_words THEN 'verbosity' END, CASE WHEN NOT g_style THEN 'style' END], lambda z: z IS NOT NULL), '|'), '') AS flags,
  coalesce(array_to_string(list_filter([CASE WHEN NOT g_distractor THEN 'distractor_quality' END, CASE WHEN NOT g_difficulty THEN 'difficulty_alignment' END, CASE WHEN NOT g_ground THEN 'decision_grounding' END], lambda z: z IS NOT NULL), '|'), '') AS targets,
  coalesce(array_to_string(list_filter([CASE WHEN NOT g_ground THEN 'decision_grounding' END, CASE WHEN NOT g_difficulty THEN 'difficulty_alignment' END, CASE WHEN NOT g_distractor THEN 'distractor_quality' END], lambda z: z IS NOT NULL), '|'), '') AS hinted FROM flag)
SELECT item_id, t1 AS tier_1_passed, t2 AS tier_2_passed, t1 AS overall_pass, t1 AND NOT t2 AS requires_repair, flags AS tier_3_flags, targets AS repair_targets, hinted, t1 AND NOT t2 AS can_repair FROM t"""),
    "composite_score": (composite_score, f"""
WITH {SQL_SCORE} SELECT item_id, round(grounding, 6) AS grounding, consistency, scope, distractor_score, novelty_score, round(composite, 3) AS composite_score, decision,
  coalesce(array_to_string(flags, '|'), '') AS flags FROM verdict"""),
    "score_again": (score_again, f"""
WITH {SQL_SCORE} SELECT CASE WHEN round(composite, 3) < 0.65 THEN 'reject' ELSE decision END AS decision, round(composite, 3) < 0.65 AS failed, count(*) AS items FROM verdict GROUP BY 1, 2"""),
    "improvement_suggestions": (improvement_suggestions, f"""
WITH {SQL_SCORE}, d AS (SELECT unnest(['grounding', 'consistency', 'scope', 'distractors', 'novelty']) AS dimension, unnest([grounding, consistency, scope, distractor_score, novelty_score]) AS s FROM verdict)
SELECT dimension, CASE dimension {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SUGGESTIONS.items())} END AS suggestion, count(*) AS items FROM d WHERE s < 0.7 GROUP BY 1, 2"""),
    "score_reports": (score_reports, f"""
WITH {SQL_SCORE} SELECT item_id, (8 + CASE WHEN len(flags) > 0 THEN 1 + len(flags) ELSE 0 END)::BIGINT AS lines, 'Decision: ' || upper(decision) AS decision_line,
  '  grounding       [' || repeat('█', floor(grounding * 10)::INT) || repeat('░', 10 - floor(grounding * 10)::INT) || '] ' || printf('%.2f', grounding) AS first_dimension FROM verdict"""),
    "repair_routing": (repair_routing, f"""
WITH {SQL_CHECKS} SELECT c.item_id, gate_name, CASE gate_name WHEN 'distractor_quality' THEN 'distractors' WHEN 'decision_grounding' THEN 'explanation' ELSE '' END AS repair_type,
  CASE gate_name WHEN 'difficulty_alignment' THEN 0 ELSE 1 END::BIGINT AS attempt,
  CASE gate_name WHEN 'difficulty_alignment' THEN 'Difficulty mismatch: adjust complexity to medium' ELSE '' END AS remaining_issue FROM check_row c WHERE tier = 2 AND NOT ok"""),
    "repairs_applied": (repairs_applied, f"""
WITH {SQL_GATES},
r AS (SELECT f.*, i.explanation, i.distractors, NOT g_ground AND i.item_id % 2 = 0 AS text_ok, NOT g_ground AND i.item_id % 2 = 1 AS text_bad,
        NOT g_distractor AND i.item_id % 3 > 0 AND len(i.distractors) = 3 AS wrong_ok, NOT g_distractor AND NOT (i.item_id % 3 > 0 AND len(i.distractors) = 3) AS wrong_bad
      FROM flag f JOIN items i USING (item_id))
SELECT item_id, ((NOT g_distractor)::INT + (NOT g_ground)::INT)::BIGINT AS repairs_attempted, g_difficulty AND NOT text_bad AND NOT wrong_bad AS fully_repaired,
  coalesce(array_to_string(list_filter([CASE WHEN wrong_bad THEN 'Distractor repair failed' END, CASE WHEN NOT g_difficulty THEN 'Difficulty mismatch: adjust complexity to medium' END, CASE WHEN text_bad THEN 'Explanation repair failed' END], lambda z: z IS NOT NULL), '|'), '') AS remaining_issues,
  md5(CASE WHEN text_ok THEN 'Because of [Q1] this holds.' ELSE explanation END) AS text_digest,
  md5(CASE WHEN wrong_ok THEN 'first wrong way|second wrong way|third wrong way' ELSE coalesce(array_to_string(distractors, '|'), '') END) AS wrong_digest FROM r"""),
    "option_rewrites": (option_rewrites, f"""
WITH {SQL_ITEMS}, n AS (SELECT *, stem AS new FROM items)
SELECT item_id, lower(new) <> lower(correct_answer) AND NOT contains(lower(new), lower(learning_target)) AND len({sql_words('new')}) BETWEEN 5 AND 20 AS option_ok,
  NOT contains(lower(stem), lower(correct_answer)) AS stem_ok FROM n"""),
    "quick_ambiguity": (quick_ambiguity, f"""
WITH {SQL_OPTIONS},
r AS (SELECT o.item_id, correct, (SELECT count(*) FROM similar_pair s WHERE s.item_id = o.item_id)
  + ({" + ".join(f"{sql_has('lower(o[correct + 1])', w)}::INT" for w in lex.VAGUE_QUALIFIERS)} >= 2)::INT
  + ({" OR ".join(f"len(list_filter(o, lambda z: contains(lower(z), '{v}'))) >= 3" for v in lex.OPTION_ACTION_VERBS)})::INT AS risks FROM opt o)
SELECT item_id, CASE WHEN risks > 0 THEN 'ambiguous' ELSE 'clear' END AS status, correct AS correct_index, CASE WHEN risks > 0 THEN 0.6 ELSE 0.7 END::DOUBLE AS confidence FROM r"""),
    "distractor_review": (distractor_review, f"""
WITH {SQL_OPTIONS},
c AS (SELECT *, len(list_filter(list_filter(o, lambda z, i: i - 1 <> correct), lambda z: regexp_matches(lower(z), '{lex.CARTOONISH_PATTERN}'))) AS odd,
        (SELECT count(*) FROM similar_pair s WHERE s.item_id = x.item_id AND NOT has_answer) AS n_similar FROM opt x)
SELECT item_id, (n_similar + CASE WHEN difficulty = 'advanced' THEN odd + (odd > 0)::INT WHEN difficulty = 'beginner' THEN (odd < 2)::INT ELSE 0 END)::BIGINT AS issues FROM c"""),
    "distractor_balance": (distractor_balance, f"""
WITH p AS (SELECT doc_id, {_PICK} AS p, ['beginner', 'intermediate', 'advanced', 'other'][(doc_id % 4 + 1)::INT] AS d FROM documents),
c AS (SELECT *, len(list_filter(p, lambda z: z IN ('opposite', 'violates_protocol'))) AS clear, len(list_filter(p, lambda z: z <> 'wrong_sequence')) AS other,
        list_filter(p, lambda z: (d = 'beginner' AND z = 'wrong_sequence') OR (d = 'advanced' AND z IN ('opposite', 'violates_protocol'))) AS banned FROM p)
SELECT doc_id, coalesce(array_to_string(list_filter(list_concat(list_concat([CASE WHEN d = 'beginner' AND clear < 2 THEN 'Need 2 clearly wrong, have ' || clear END],
  list_transform(banned, lambda z: 'Forbidden pattern used: ' || z)), [CASE WHEN d = 'advanced' AND other > 0 THEN 'Advanced has ' || other || ' non-sequence distractors' END]), lambda z: z IS NOT NULL), '; '), '') AS issues FROM c"""),
    "pattern_suggestions": (pattern_suggestions, f"""
WITH p AS (SELECT doc_id, lower(['assess it ', 'wait ', 'secure the scene ', 'position '][(doc_id % 4 + 1)::INT] || text[1:len(text) // 2]) AS a, lower(substr(text, len(text) // 2 + 1)) AS s,
             ['beginner', 'intermediate', 'advanced'][(doc_id % 3 + 1)::INT] AS d FROM documents),
k AS (SELECT *, {" OR ".join(f"contains(a, '{w}') OR contains(s, '{w}')" for w in lex.SEQUENCE_CUES)} AS seq, {" OR ".join(f"contains(a, '{w}') OR contains(s, '{w}')" for w in lex.SAFETY_CUES)} AS safe FROM p),
f AS (SELECT doc_id, list_filter([CASE WHEN seq AND d <> 'beginner' THEN 'wrong_sequence' END,
  {", ".join(f"CASE WHEN contains(a, '{v}') AND d <> 'advanced' THEN 'incomplete' END, CASE WHEN contains(a, '{v}') AND d = 'intermediate' THEN 'wrong_context' END" for v in lex.SUGGESTION_VERBS)},
  CASE WHEN safe AND d = 'beginner' THEN 'violates_protocol' END, CASE WHEN safe AND d = 'beginner' THEN 'common_misconception' END], lambda z: z IS NOT NULL)[1:4] AS x FROM k)
SELECT doc_id, coalesce(array_to_string(x, '|'), '') AS patterns FROM f"""),
    "novelty_check": (novelty_check, f"""
WITH {SQL_CONCEPTS},
shared AS (SELECT b.pos AS pos, a.pos AS other, count(*) AS k FROM word a JOIN word b ON a.w = b.w AND a.pos % 2 = 0 AND b.pos % 2 = 1 GROUP BY ALL),
pair AS (
  SELECT b.pos, a.pos AS other, a.tag, alike * 0.4::DOUBLE + coalesce(k::DOUBLE / (len(a.terms) + len(b.terms) - k), 0) * 0.6::DOUBLE AS sim
  FROM concept a JOIN concept b ON a.pos % 2 = 0 AND b.pos % 2 = 1 JOIN tag_pair t ON t.a = a.tag AND t.b = b.tag LEFT JOIN shared s ON s.pos = b.pos AND s.other = a.pos),
best AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY pos ORDER BY sim DESC, other) = 1)
SELECT c.pos, coalesce(b.sim, 0) < 0.7 AS is_novel, round(coalesce(b.sim, 0), 6)::DOUBLE AS similarity_score, CASE WHEN b.sim >= 0.7 THEN b.tag ELSE '' END AS similar_tag,
  CASE WHEN b.sim >= 0.7 THEN array_to_string(list_sort(list_intersect(c.terms, o.terms)), '|') ELSE '' END AS similar_terms
FROM concept c LEFT JOIN best b USING (pos) LEFT JOIN concept o ON o.pos = b.other WHERE c.pos % 2 = 1"""),
    "novelty_vectors": (novelty_vectors, """
WITH concept AS (SELECT vec_id AS pos, 'group' || (vec_id % 397) AS tag, 'topic' || (vec_id % 389) AS term, embedding::DOUBLE[] AS v FROM embeddings),
pair AS (
  SELECT b.pos AS pos, a.pos AS other, a.tag, CASE WHEN a.term = b.term THEN a.term ELSE '' END AS shared,
    ((a.tag = b.tag)::INT * 0.4::DOUBLE + (a.term = b.term)::INT * 0.6::DOUBLE) * 0.5::DOUBLE + list_cosine_similarity(a.v, b.v) * 0.5::DOUBLE AS sim
  FROM concept a JOIN concept b ON a.pos % 2 = 0 AND b.pos % 2 = 1),
best AS (SELECT *, sim >= 0.16 AS near FROM pair QUALIFY row_number() OVER (PARTITION BY pos ORDER BY sim DESC, other) = 1)
SELECT c.pos, NOT coalesce(near, false) AS is_novel, round(greatest(coalesce(b.sim, 0), 0), 6)::DOUBLE AS similarity_score, CASE WHEN near THEN b.tag ELSE '' END AS similar_tag,
  CASE WHEN near THEN b.shared ELSE '' END AS similar_terms
FROM concept c LEFT JOIN best b USING (pos) WHERE c.pos % 2 = 1"""),
    "greedy_dedup": (greedy_dedup, SQL_GREEDY),
    "soft_novelty": (soft_novelty, f"""
WITH d AS (SELECT doc_id, list_distinct({sql_words("lower(coalesce(text, '')) || ' ' || lang")}) AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS w FROM d),
k AS (SELECT b.doc_id, a.doc_id AS other, count(*)::DOUBLE AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT doc_id, other, k / (na + nb - k) AS sim FROM k),
f AS (SELECT doc_id, min(other) AS other, arg_min(sim, other) AS sim FROM p WHERE sim > 0.6 GROUP BY 1)
SELECT d.doc_id AS item_id, f.other AS similar_item_id, round(f.sim, 6) AS similarity FROM d LEFT JOIN f USING (doc_id)"""),
    "quality_metrics": (quality_metrics, f"WITH {SQL_RECORDS} SELECT {_METRICS}, count(DISTINCT capsule_id) AS total_capsules FROM record"),
    "capsule_metrics": (capsule_metrics, f"WITH {SQL_RECORDS} SELECT capsule_id, {_METRICS} FROM record GROUP BY 1"),
    "difficulty_distribution": (difficulty_distribution, f"WITH {SQL_RECORDS} SELECT difficulty, count(*) AS items FROM record GROUP BY 1"),
    "metrics_text": (metrics_text, None),
}
