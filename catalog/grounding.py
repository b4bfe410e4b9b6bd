"""Queries that check texts against their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    SQL_LINKS, SQL_SOURCE_ITEMS, links, plain, source_items, sql_has, sql_list, sql_sentences, sql_strip, sql_words, table,
)
from lectern.functions import lexicon as lex
from lectern.functions import text as T
from lectern.operators import anchors as A
from lectern.operators import claims as C
from lectern.operators import quotes as Q


def _claims_sql(source: str) -> str:
    """Claims of ``source(item_id, explanation)``."""
    kind = "'factual'"
    for name, words in (
        ("procedural", "should|must|requires?|ensures?"), ("definition", "is defined as|is a|is an|means|refers to"),
        ("rationale", "because|therefore|thus|since|this is why"), ("distractor", "is wrong|is incorrect|incorrect because|wrong because"),
    ):
        kind = f"CASE WHEN {sql_has('low', words)} THEN '{name}' ELSE {kind} END"
    return f"""
sent AS (SELECT item_id, generate_subscripts(s, 1) AS pos, unnest(s) AS sentence FROM (SELECT item_id, {sql_sentences('explanation', '.!')} AS s FROM {source})),
low AS (SELECT *, lower(sentence) AS low FROM sent),
raw AS (
  SELECT item_id, pos, 0 AS k, sentence AS claim, {kind} AS claim_type, {sql_has('low', 'correct|right|best|appropriate|should')} AS is_critical
  FROM low WHERE NOT regexp_matches(low, '^the source states?') AND length(sentence) > 30
  UNION ALL
  SELECT item_id, pos, generate_subscripts(q, 1), unnest(q), 'factual', true
  FROM (SELECT *, regexp_extract_all(sentence, '"([^"]+)"', 1) AS q FROM low WHERE regexp_matches(low, '^the source states?'))),
claim AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY pos, k) - 1 AS claim_pos, claim, claim_type, is_critical FROM raw)
"""


def _told(df):
    """Explanations with the wording that makes claims of every kind."""
    return df.withColumn(
        "explanation",
        F.concat(
            F.lit('The source states "'), F.substring("explanation", 1, 60), F.lit('". This option is wrong because it is premature and follows late. '),
            F.lit("It is best since the crew should wait. "), F.col("explanation"),
        ),
    )


SQL_TOLD = """
told AS (SELECT * REPLACE ('The source states "' || explanation[1:60] || '". This option is wrong because it is premature and follows late. '
  || 'It is best since the crew should wait. ' || explanation AS explanation) FROM source_items)
"""


def claim_extract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("explanation"))
    return plain(C.extract_claims(_told(docs)).select("item_id", "claim_pos", "claim", "claim_type", "is_critical"))


def claim_match(spark, sf_dir):
    matched = C.match_claims(C.extract_claims(_told(source_items(spark, sf_dir))), links(spark, sf_dir), 0.3)
    return plain(matched.select("item_id", "claim_pos", "claim", "status", "matched_chunk_id", F.coalesce("matched_text", F.lit("")).alias("matched_text"), "confidence"))


def _match_sql(threshold: float) -> str:
    return f"""
pair AS (
  SELECT c.item_id, c.claim_pos, l.chunk_id, l.chunk_pos, lower(c.claim) AS low, lower(l.text) AS text,
         list_distinct({sql_words('lower(c.claim)')}) AS words FROM claim c JOIN links l USING (item_id)),
scored AS (
  SELECT *, contains(text, low) AS exact, len(list_intersect(words, list_distinct({sql_words('text')})))::DOUBLE / greatest(len(words), 1) AS score,
         {sql_strip(f"list_filter(string_split(text, '.'), lambda p: len(list_intersect(words, list_distinct({sql_words('p')})))::DOUBLE / greatest(len(words), 1) > 0.5)[1]")} AS part
  FROM pair),
ahead AS (SELECT *, max(CASE WHEN exact THEN NULL ELSE score END) OVER (PARTITION BY item_id, claim_pos ORDER BY chunk_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM scored),
step AS (SELECT *, NOT exact AND score > coalesce(before, 0) AS is_step FROM ahead),
best AS (
  SELECT item_id, claim_pos, arg_min(chunk_id, chunk_pos) FILTER (exact) AS exact_id, coalesce(max(score) FILTER (is_step), 0) AS score,
         arg_max(chunk_id, score) FILTER (is_step) AS best_id, arg_max(part, score) FILTER (is_step AND part IS NOT NULL) AS part
  FROM step GROUP BY 1, 2),
matched AS (
  SELECT c.*, coalesce(CASE WHEN exact_id IS NOT NULL THEN 1.0 ELSE score END, 0)::DOUBLE AS confidence, exact_id, best_id, part FROM claim c LEFT JOIN best b USING (item_id, claim_pos)),
judged AS (
  SELECT *, CASE WHEN confidence >= 0.8 THEN 'pass' WHEN confidence >= {threshold} THEN 'repair' ELSE 'reject' END AS status FROM matched)
"""


def admission_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    phrases = T.words_array(lex.SOURCE_ADMISSIONS)
    told = F.concat("text", F.lit(" "), F.when(F.col("doc_id") % 2 == 0, F.upper(F.element_at(phrases, (F.col("doc_id") % len(lex.SOURCE_ADMISSIONS) + 1).cast("int")))).otherwise(""))
    return plain(docs.select("doc_id", F.coalesce(C.admission_phrase(told), F.lit("")).alias("phrase")))


def answer_support(spark, sf_dir):
    items = source_items(spark, sf_dir).withColumn(
        "explanation", F.concat(F.lit("A hissing sound, 30 feet away for 7 minutes, 12% of cases. It can be inferred. "), F.col("explanation"))
    )
    return plain(C.check_items_against_source(items, links(spark, sf_dir)))


SQL_SUPPORT = f"""
needle AS (
  SELECT item_id, list_transform(list_filter({sql_words('lower(correct_answer)')}, lambda z: length(z) > 3 AND NOT list_contains({sql_list(lex.ANSWER_STOP_WORDS)}, z)),
           lambda z: trim(z, '.,!?()[]"''')) AS k,
         list_concat(
           list_concat(list_concat(regexp_extract_all(low, '([\\p{{L}}\\p{{N}}_]+ing sound)', 1), regexp_extract_all(low, '(crackling|popping|sizzling)', 1)),
                       list_concat(regexp_extract_all(low, '(smell(?:s)? (?:of |like )?[\\p{{L}}\\p{{N}}_]+)', 1), regexp_extract_all(low, '(blue|yellow|orange|green) (?:color|flash|glow)', 1))),
           list_concat(list_concat(regexp_extract_all(low, '([0-9]+)\\s*(?:feet|meters|yards|inches)', 1), regexp_extract_all(low, '([0-9]+)\\s*(?:minutes?|seconds?|hours?)', 1)),
                       regexp_extract_all(low, '([0-9]+)\\s*(?:percent|%)', 1))) AS d, low
  FROM (SELECT *, lower('A hissing sound, 30 feet away for 7 minutes, 12% of cases. It can be inferred. ' || explanation) AS low FROM source_items)),
every AS (SELECT item_id, list(lower(text)) AS texts FROM links GROUP BY 1),
hit AS (
  SELECT n.item_id, list_filter(k, lambda z: len(list_filter(texts, lambda t: contains(t, z))) > 0) AS m,
         list_filter(k, lambda z: len(list_filter(texts, lambda t: contains(t, z))) = 0) AS x,
         list_concat(list_filter(d, lambda z: len(list_filter(texts, lambda t: contains(t, z))) = 0), list_filter({sql_list(lex.INFERENCE_ADMISSIONS)}, lambda z: contains(low, z)))[1:5] AS u
  FROM needle n JOIN every USING (item_id))
"""


def item_verdicts(spark, sf_dir):
    items = _told(source_items(spark, sf_dir))
    return plain(C.verify_items(items, links(spark, sf_dir)).withColumn("rejection_reason", F.coalesce("rejection_reason", F.lit(""))))


def strict_verdicts(spark, sf_dir):
    items = source_items(spark, sf_dir).withColumn("correct_answer", F.lit(None).cast("string"))
    return plain(C.verify_items(items, links(spark, sf_dir), "strict").drop("critical_failures").withColumn("rejection_reason", F.coalesce("rejection_reason", F.lit(""))))


def claim_repairs(spark, sf_dir):
    """Explanations that copy a chunk sentence by sentence with every third word changed."""
    sources = links(spark, sf_dir)
    changed = lambda s: F.array_join(F.transform(T.split_words(s), lambda w, i: F.when(i % 3 == 0, F.lit("zz")).otherwise(w)), " ")
    told = F.transform(T.sentences("text"), lambda s: F.concat(F.regexp_replace(changed(s), r"[.!?]", ""), F.lit(".")))
    items = sources.select(F.col("chunk_id").alias("item_id"), F.array_join(told, " ").alias("explanation"))
    own = sources.withColumn("item_id", F.col("chunk_id"))
    matched = C.match_claims(C.extract_claims(items), own, 0.3)
    return plain(C.repair_list(matched).select("item_id", "claim_pos", "claim", "source_text"))


def _quote_inputs(spark, sf_dir):
    """Each document with all its sentences as required quotes, every second one without its end mark,
    all sentences of its benchmark item, and one id that does not exist."""
    n = table(spark, sf_dir, "benchmark").count()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", (F.col("doc_id") % n).alias("b"), T.sentences("text").alias("s"))
    given = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("b"), T.sentences("text").alias("g"))
    both = docs.join(given, "b", "left").withColumn("g", F.coalesce("g", T.words_array([])))
    named = lambda c, kind: F.transform(c, lambda x, i: F.concat(F.lit(kind), i + 1))
    every = F.concat(named("s", "Q"), named("g", "B"), F.array(F.lit("none")))
    texts = both.select("item_id", F.col("text").alias("generated_text"), F.when(F.col("item_id") % 4 > 0, every).alias("required_quote_ids"))
    bare = lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, r"[.!?]+$", " ")).otherwise(x)
    own = docs.select("item_id", F.posexplode("s").alias("i", "x")).select("item_id", F.concat(F.lit("Q"), F.col("i") + 1).alias("quote_id"), bare(F.col("x"), F.col("i")).alias("text"))
    lent = both.select("item_id", F.posexplode("g").alias("i", "text")).select("item_id", F.concat(F.lit("B"), F.col("i") + 1).alias("quote_id"), "text")
    return texts, own.unionByName(lent)


def quote_verify(spark, sf_dir):
    texts, quotes = _quote_inputs(spark, sf_dir)
    return plain(Q.verify_quotes(texts, quotes, fuzzy=False))


def quote_verify_fuzzy(spark, sf_dir):
    texts, quotes = _quote_inputs(spark, sf_dir)
    return plain(Q.verify_quotes(texts, quotes))


_PLAIN = "trim(lower(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s'']', '', 'g')))"
_QUOTE_TABLES = f"""
WITH g AS (SELECT item_id AS b, {sql_sentences('text')} AS g FROM benchmark),
d AS (SELECT doc_id AS item_id, text, s, coalesce(g, []) AS g, CASE WHEN doc_id % 4 > 0 THEN
  list_concat(list_concat(list_transform(s, lambda z, i: 'Q' || i), list_transform(coalesce(g, []), lambda z, i: 'B' || i)), ['none']) END AS required
  FROM (SELECT *, {sql_sentences('text')} AS s FROM documents) LEFT JOIN g ON b = doc_id % (SELECT count(*) FROM benchmark)),
known AS (
  SELECT item_id, 'Q' || i AS id, CASE WHEN i % 2 = 0 THEN regexp_replace(t, '[.!?]+$', ' ') ELSE t END AS t FROM (SELECT item_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM d)
  UNION ALL SELECT item_id, 'B' || generate_subscripts(g, 1), unnest(g) FROM d),
need AS (SELECT item_id, unnest(required) AS id FROM d WHERE required IS NOT NULL UNION ALL SELECT k.item_id, id FROM known k JOIN d USING (item_id) WHERE required IS NULL),
p AS (SELECT n.item_id, n.id, lower(trim(k.t)) AS q, lower(d.text) AS low, coalesce(contains(d.text, trim(k.t)), false) AS exact,
        coalesce(contains({_PLAIN.format(x='d.text')}, {_PLAIN.format(x='k.t')}), false) AS plain
      FROM need n JOIN d USING (item_id) LEFT JOIN known k ON k.item_id = n.item_id AND k.id = n.id)"""
_QUOTE_COUNTS = """
SELECT d.item_id, count(c.id) AS required_count, count(*) FILTER (exact) AS exact_match_count, count(*) FILTER (near AND NOT exact) AS fuzzy_match_count,
       coalesce(string_agg(c.id, '|' ORDER BY c.id) FILTER (NOT exact AND NOT near), '') AS missing_quote_ids,
       count(*) FILTER (c.id IS NOT NULL AND NOT exact AND NOT near) = 0 AS all_required_found
FROM d LEFT JOIN c USING (item_id) GROUP BY 1
"""
SQL_QUOTES = f"{_QUOTE_TABLES}, c AS (SELECT item_id, id, exact, plain AS near FROM p) {_QUOTE_COUNTS}"
# every window of the quote's length, in blocks of 256, first with all characters beyond ASCII taken for one (a bound), then exactly
SQL_QUOTES_FUZZY = f"""{_QUOTE_TABLES},
s AS MATERIALIZED (SELECT *, length(q) AS n, regexp_replace(q, '[^\\x00-\\x7F]', '?', 'g') AS q7, rpad(regexp_replace(low, '[^\\x00-\\x7F]', '?', 'g'), greatest(length(low), length(q))::INT, chr(1)) AS low7
      FROM p WHERE NOT exact AND NOT plain AND q <> '' AND low <> ''),
blk AS MATERIALIZED (SELECT item_id, id, n, q7, o, substr(low7, o + 1, 255 + n) AS piece FROM s, unnest(range(0, length(low7), 256)) AS u(o)),
w AS (SELECT item_id, id, o + i AS i FROM blk, unnest(range(1, length(piece) - n + 2)) AS u(i) WHERE (n - hamming(substr(piece, i, n), q7)) / n >= 0.85),
reached AS (SELECT DISTINCT item_id, id FROM w JOIN s USING (item_id, id) WHERE len(list_filter(range(1, n + 1), lambda j: substr(low, i + j - 1, 1) <> '' AND substr(low, i + j - 1, 1) = substr(q, j, 1))) / n >= 0.85),
c AS (SELECT p.item_id, p.id, exact, plain OR reached.id IS NOT NULL AS near FROM p LEFT JOIN reached ON reached.item_id = p.item_id AND reached.id = p.id) {_QUOTE_COUNTS}"""


def quote_offsets(spark, sf_dir):
    """Every sentence at its first place in the text, in every second document one character off."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(T.sentences("text")).alias("quote_pos", "q"))
    at = F.position(F.col("q"), F.col("text")) - 1
    shifted = at + (F.col("doc_id") % 2).cast("int")
    ok = Q.verify_offsets("q", shifted, shifted + F.length("q"), "text")
    free = Q.verify_offsets("q", F.lit(-1), F.lit(-1), "text")
    return plain(docs.select("doc_id", "quote_pos", ok.alias("by_offset"), free.alias("by_text")))


ANCHOR_LEXICON = {"action_words": ["that", "with", "for"], "factual_pattern": r"\b(?:is a|is the|are the)\b"}


def anchor_select(spark, sf_dir):
    return plain(A.select_anchors(source_items(spark, sf_dir), links(spark, sf_dir), **ANCHOR_LEXICON))


def anchor_usage(spark, sf_dir):
    """Do the documents reuse wording of the sentences of their benchmark item? Every second one is
    followed by that item's text with every fifth word changed."""
    sources = source_items(spark, sf_dir).select(F.col("item_id").alias("b"), F.col("explanation").alias("given"))
    told = F.array_join(F.transform(T.split_words("given"), lambda w, i: F.when(i % 5 == 4, F.lit("zz")).otherwise(w)), " ")
    rows = links(spark, sf_dir).withColumnRenamed("item_id", "b").join(sources, "b")
    questions = rows.select(
        F.col("chunk_id").alias("item_id"), F.lit("").alias("correct_answer"),
        F.when(F.col("chunk_id") % 2 == 0, F.concat_ws(" ", "text", told)).otherwise(F.col("text")).alias("explanation"),
    )
    anchors = rows.select(F.col("chunk_id").alias("item_id"), F.explode(T.sentences("given")).alias("anchor_text"))
    return plain(A.anchor_usage(questions, anchors))


QUERIES = {
    "claim_extract": (claim_extract, f"""
WITH source_items AS (SELECT doc_id AS item_id, text AS explanation FROM documents), {SQL_TOLD}, {_claims_sql('told')}
SELECT item_id, claim_pos, claim, claim_type, is_critical FROM claim"""),
    "claim_match": (claim_match, f"""
WITH {SQL_SOURCE_ITEMS}, {SQL_LINKS}, {SQL_TOLD}, {_claims_sql('told')}, {_match_sql(0.3)}
SELECT item_id, claim_pos, claim, status, CASE WHEN status = 'reject' THEN NULL WHEN exact_id IS NOT NULL THEN exact_id ELSE best_id END AS matched_chunk_id,
       coalesce(CASE WHEN exact_id IS NOT NULL THEN claim WHEN status <> 'reject' THEN part END, '') AS matched_text, round(confidence, 6) AS confidence FROM judged"""),
    "admission_flags": (admission_flags, f"""
WITH t AS (SELECT doc_id, lower(text || ' ' || CASE WHEN doc_id % 2 = 0 THEN upper({sql_list(lex.SOURCE_ADMISSIONS)}[(doc_id % {len(lex.SOURCE_ADMISSIONS)} + 1)::INT]) ELSE '' END) AS low FROM documents)
SELECT doc_id, coalesce(list_filter({sql_list(lex.SOURCE_ADMISSIONS)}, lambda z: contains(low, z))[1], '') AS phrase FROM t"""),
    "answer_support": (answer_support, f"""
WITH {SQL_SOURCE_ITEMS}, {SQL_LINKS}, {SQL_SUPPORT}
SELECT item_id, coalesce(array_to_string(m, '|'), '') AS matched_keywords, coalesce(array_to_string(x, '|'), '') AS missing_keywords,
       coalesce(array_to_string(u, '|'), '') AS unsupported, len(m) >= least(2, len(m) + len(x)) AS is_supported FROM hit"""),
    "item_verdicts": (item_verdicts, f"""
WITH {SQL_SOURCE_ITEMS}, {SQL_LINKS}, {SQL_TOLD}, {_claims_sql('told')}, {_match_sql(0.6)}, {SQL_SUPPORT},
lifted AS (
  SELECT *, status = 'reject' AND (claim_type = 'distractor' OR (claim_type = 'rationale' AND NOT is_critical))
    AND regexp_matches(lower(claim), '{"|".join(p.replace("'", "''") for p in lex.ALLOWED_INFERENCE_PATTERNS)}') AS lift FROM judged),
n AS (
  SELECT item_id, count(*) FILTER (status = 'pass' OR lift) AS p, count(*) FILTER (status = 'repair') AS r, count(*) FILTER (status = 'reject' AND NOT lift) AS x,
    count(*) FILTER (lift) AS a, count(*) FILTER (status = 'reject' AND NOT lift AND is_critical) AS k,
    string_agg(claim[1:50], '|' ORDER BY claim_pos) FILTER (status = 'reject' AND NOT lift AND is_critical) AS failures FROM lifted GROUP BY 1),
v AS (SELECT i.item_id, coalesce(n.p, 0) AS p, coalesce(n.r, 0) AS r, coalesce(n.x, 0) AS x, coalesce(n.a, 0) AS a, coalesce(n.k, 0) AS k, failures,
        NOT coalesce(len(h.m) >= least(2, len(h.m) + len(h.x)), false) AS unsupported FROM source_items i LEFT JOIN n USING (item_id) LEFT JOIN (SELECT item_id, m, hit.x AS x FROM hit) h USING (item_id))
SELECT item_id, CASE WHEN unsupported OR k > 0 THEN 'reject' WHEN r > p AND x > a THEN 'repair' ELSE 'pass' END AS status,
  CASE WHEN unsupported THEN 0 ELSE p END AS pass_count, CASE WHEN unsupported THEN 0 ELSE r END AS repair_count, CASE WHEN unsupported THEN 0 ELSE x END AS reject_count,
  CASE WHEN unsupported THEN 'answer_not_supported' WHEN k > 0 THEN 'critical_claims' ELSE '' END AS rejection_reason,
  CASE WHEN unsupported THEN NULL ELSE coalesce(failures, '') END AS critical_failures FROM v"""),
    "strict_verdicts": (strict_verdicts, f"""
WITH {SQL_SOURCE_ITEMS}, {SQL_LINKS}, {_claims_sql('source_items')}, {_match_sql(0.6)},
n AS (SELECT item_id, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'repair') AS r, count(*) FILTER (status = 'reject') AS x,
        count(*) FILTER (status = 'reject' AND is_critical) AS k FROM judged GROUP BY 1),
v AS (SELECT i.item_id, coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce(x, 0) AS x, coalesce(k, 0) AS k FROM source_items i LEFT JOIN n USING (item_id))
SELECT item_id, CASE WHEN k > 0 OR x > p THEN 'reject' WHEN r > 0 THEN 'repair' ELSE 'pass' END AS status, p AS pass_count, r AS repair_count, x AS reject_count,
  CASE WHEN k > 0 THEN 'critical_claims' WHEN x > p THEN 'too_many_unverified' ELSE '' END AS rejection_reason FROM v"""),
    "claim_repairs": (claim_repairs, f"""
WITH w AS (SELECT doc_id AS item_id, generate_subscripts(s, 1) AS n, {sql_words('unnest(s)')} AS w FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)),
source_items AS (SELECT item_id, string_agg(regexp_replace(array_to_string(list_transform(w, lambda z, i: CASE WHEN (i - 1) % 3 = 0 THEN 'zz' ELSE z END), ' '), '[.!?]', '', 'g') || '.', ' ' ORDER BY n) AS explanation FROM w GROUP BY 1),
links AS (SELECT doc_id AS item_id, doc_id AS chunk_id, 0 AS chunk_pos, text FROM documents), {_claims_sql('source_items')}, {_match_sql(0.3)}
SELECT item_id, claim_pos, claim[1:100] AS claim, part AS source_text FROM judged WHERE status = 'repair' AND part IS NOT NULL"""),
    "quote_verify": (quote_verify, SQL_QUOTES),
    "quote_verify_fuzzy": (quote_verify_fuzzy, SQL_QUOTES_FUZZY),
    "quote_offsets": (quote_offsets, f"""
WITH d AS (SELECT doc_id, text, unnest(s) AS q, generate_subscripts(s, 1) - 1 AS quote_pos FROM (SELECT *, {sql_sentences('text')} AS s FROM documents))
SELECT doc_id, quote_pos, substr(text, position(q IN text) + doc_id % 2, length(q)) = q AS by_offset, contains(text, q) AS by_text FROM d"""),
    "anchor_select": (anchor_select, None),
    "anchor_usage": (anchor_usage, f"""
WITH {SQL_SOURCE_ITEMS}, {SQL_LINKS},
a AS (SELECT l.chunk_id AS item_id, ' ' || lower(CASE WHEN l.chunk_id % 2 = 0 THEN concat_ws(' ', l.text, told) ELSE l.text END) AS low, {sql_words('lower(anchor)')} AS w
      FROM links l JOIN (SELECT item_id, unnest({sql_sentences('explanation')}) AS anchor,
        array_to_string(list_transform({sql_words('explanation')}, lambda z, i: CASE WHEN i % 5 = 0 THEN 'zz' ELSE z END), ' ') AS told FROM source_items) s USING (item_id)),
k AS (SELECT *, row_number() OVER () AS id FROM a),
run AS (SELECT id, low, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM k, unnest(range(3, len(w) + 1)) AS u(n), unnest(range(1, len(w) - n + 2)) AS v(i)),
hit AS (SELECT id, arg_min(phrase, n * 1000 + i) AS phrase FROM run WHERE length(phrase) >= 15 AND contains(low, phrase) GROUP BY 1)
SELECT item_id, count(phrase) AS matched, count(*) - count(phrase) AS missing, coalesce(string_agg(phrase, '|' ORDER BY phrase), '') AS phrases,
       count(phrase) >= 1 AND count(*) - count(phrase) <= count(*) // 2 AS is_valid
FROM k LEFT JOIN hit USING (id) GROUP BY 1"""),
}
