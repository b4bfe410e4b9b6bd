"""Queries over texts, names and books."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    SQL_LINKS, SQL_SOURCE_ITEMS, links, plain, source_items, sql_has, sql_jaccard,
    sql_sentences, sql_strip, sql_terms, sql_words, table,
)
from lectern.functions import lexicon as lex
from lectern.functions import naming as N
from lectern.functions import text as T
from lectern.operators import chunking, routing
from lectern.operators.quotes import chunk_quotes, dedup_quotes
from lectern.operators.unnest import unnest_structs

# cue words that occur in the given texts
ACTION = "that|for|with"
FACTUAL = "is a|is an|is the|are the|des|die"
PROCEDURAL = "then|from|pour"
LEXICON = {
    "action_pattern": rf"\b(?:{ACTION})\b",
    "factual_pattern": rf"\b(?:{FACTUAL})\b",
    "procedural_pattern": rf"\b(?:{PROCEDURAL})\b",
}

SQL_SCORED = f"""
sentence AS (
  SELECT d.*, generate_subscripts(s, 1) - 1 AS sentence_pos, unnest(s) AS sentence
  FROM (SELECT doc_id, source, text, {sql_sentences('text')} AS s FROM documents) d),
scored AS (
  SELECT doc_id, source, sentence_pos, sentence, position(sentence IN text) - 1 AS start_char,
         (CASE WHEN {sql_has('lower(sentence)', ACTION)} THEN 0.3::DOUBLE ELSE 0 END)
         + (CASE WHEN {sql_has('lower(sentence)', FACTUAL)} THEN 0.2::DOUBLE ELSE 0 END)
         + (CASE WHEN {sql_has('lower(sentence)', PROCEDURAL)} THEN 0.2::DOUBLE ELSE 0 END) AS score
  FROM sentence
  WHERE length(sentence) BETWEEN 30 AND 200 AND NOT ends_with(sentence, '?') AND left(sentence, 1) NOT IN ('-', '*')
    AND left(sentence, 2) NOT IN ('1.', '2.', '3.')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sentence_pos) AS quote_rank
  FROM scored WHERE score > 0)
"""


def quotable_top3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return plain(chunk_quotes(docs, **LEXICON))


def quote_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    quotes = chunk_quotes(docs, **LEXICON)
    return plain(dedup_quotes(quotes, ["doc_id", "quote_rank"], "source").select("source", "doc_id", "quote_rank", "sentence"))


def key_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.key_terms("text").alias("t"))
    return plain(rows.select("doc_id", F.size("t").alias("terms"), F.size(F.array_distinct("t")).alias("distinct_terms"), F.md5(F.array_join("t", " ")).alias("digest")))


def concept_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.concept_terms("text").alias("t"))
    return plain(rows.select("doc_id", F.size("t").alias("terms"), F.md5(F.array_join("t", " ")).alias("digest")))


def _sql_terms_of(stop, extra: str = "") -> str:
    terms = sql_terms("text", stop)
    if extra:
        terms = f"list_filter({terms}, lambda z: {extra})"
    return f"(SELECT doc_id, {terms} AS t FROM documents)"


def sentence_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.sentences("text").alias("s"))
    usable = F.filter("s", lambda x: F.length(x).between(30, 200))
    return plain(rows.select("doc_id", F.size("s").alias("sentences"), F.size(usable).alias("usable"), T.word_count(F.array_join("s", " ")).alias("words")))


def anchor_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", T.anchor_sentences("text", action_words=["that", "with"], factual_pattern=rf"\b(?:{FACTUAL})\b").alias("s")
    )
    return plain(rows.select("doc_id", F.size("s").alias("candidates"), F.md5(F.array_join("s", "\n")).alias("digest")))


def relevance(spark, sf_dir):
    pairs = links(spark, sf_dir).join(source_items(spark, sf_dir), "item_id")
    score = T.relevance("text", "learning_target", "difficulty", action_verbs=["with", "pour"], priority_words=["from", "die"])
    return plain(pairs.select("item_id", "chunk_id", score.alias("score")))


def term_jaccard(spark, sf_dir):
    pairs = links(spark, sf_dir).join(source_items(spark, sf_dir), "item_id")
    score = T.jaccard(F.array_distinct(T.key_terms("text")), F.array_distinct(T.key_terms("explanation")))
    return plain(pairs.select("item_id", "chunk_id", score.alias("jaccard")))


def tag_similarity(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brand = F.concat_ws(" - ", "p_name", "p_brand")
    return plain(part.select(
        "p_partkey", T.normalize_tag(brand).alias("tag"), T.tag_similarity(brand, F.concat_ws("_", "p_type", "p_name")).alias("similarity")
    ))


def names_sanitised(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return plain(pages.select(
        "page_id", N.collection_name("url").alias("collection"), N.collection_name(title).alias("title_collection"),
        N.file_name("url").alias("file"), N.file_name(title, 30).alias("short_file"), N.slug("url").alias("slug"),
        N.entity_key(title).alias("entity_key"), N.snapshot_name(title).alias("snapshot"),
    ))


def _sql_collection(x: str) -> str:
    clean = f"trim(regexp_replace({x}, '[^a-zA-Z0-9_-]', '_', 'g'), '_-')"
    return (
        f"CASE WHEN length({clean}) < 3 THEN rpad(CASE WHEN {clean} = '' THEN 'a' ELSE {clean} END, 3, 'a')"
        f" WHEN length({clean}) > 63 THEN rtrim(left({clean}, 63), '_-') ELSE {clean} END"
    )


def _sql_file(x: str, n: int) -> str:
    clean = f"trim(regexp_replace({x}, '[<>:\"/\\\\|?*]', '_', 'g'), '. ')"
    return f"CASE WHEN length({clean}) > {n} THEN trim(left({clean}, {n}), '. ') ELSE {clean} END"


def match_normalise(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.normalize_for_matching("text").alias("n"))
    return plain(docs.select("doc_id", F.length("n").alias("chars"), F.md5("n").alias("digest")))


def content_hashes(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    digest = F.md5("url")
    kind = F.col("page_id") % 4
    link = (
        F.when(kind == 0, F.concat("url", F.lit("&md5="), digest, F.lit("&x=1")))
        .when(kind == 1, F.concat(F.lit("http://a/md5/"), digest, F.lit("/get")))
        .when(kind == 2, F.concat(F.lit("http://a/main/"), digest, F.lit("/f.pdf")))
        .otherwise(F.lit("http://a/none"))
    )
    return plain(pages.select("page_id", N.content_hash(F.lit(None).cast("string"), F.array("url", link)).alias("hash")))


# --- books: the pages with <h1> as heading lines ----------------------------------------------


def _markdown():
    return F.regexp_replace(F.regexp_replace("html", "<h1>([^<]*)</h1>", "\n# $1\n"), r'<a href="([^"]*)">([^<]*)</a>', "![$2]($1)")


SQL_MARKDOWN = (
    "regexp_replace(regexp_replace(html, '<h1>([^<]*)</h1>', chr(10) || '# \\1' || chr(10), 'g'),"
    " '<a href=\"([^\"]*)\">([^<]*)</a>', '![\\2](\\1)', 'g')"
)


def heading_chunks(spark, sf_dir):
    pages = unnest_structs(table(spark, sf_dir, "pages"), chunking.heading_sections(_markdown()), ["page_id"])
    return plain(pages.select(
        "page_id", "section_pos", F.coalesce("section_heading", F.lit("(none)")).alias("heading"), F.length("text").alias("chars"), F.md5("text").alias("digest"),
        F.array_join(chunking.image_paths("text"), ",").alias("images"),
    ))


def _books(spark, sf_dir):
    """Every page as a book whose blocks are its lines, three lines to a page."""
    lines = F.split(_markdown(), "\n")
    blocks = F.transform(
        lines, lambda x, i: F.struct(T.strip(F.regexp_replace(x, "^# ", "")).alias("text"), F.floor(i / 3).cast("int").alias("page_idx"))
    )
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("book_id"), _markdown().alias("markdown"), blocks.alias("blocks"),
        F.col("url").alias("book_title"), F.lit("Unknown").alias("book_author"), F.col("url").alias("source_file"),
    )


def chunk_pages(spark, sf_dir):
    chunks = chunking.chunk_books(_books(spark, sf_dir))
    return plain(chunks.select(
        "book_id", "chunk_pos", F.coalesce("section_heading", F.lit("(none)")).alias("heading"), F.md5("text").alias("digest"), "page_numbers",
    ))


SQL_CHUNK_PAGES = f"""
WITH md AS (SELECT page_id AS book_id, {SQL_MARKDOWN} AS m FROM pages),
part AS (SELECT book_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS part
         FROM (SELECT book_id, string_split(chr(10) || m, chr(10) || '# ') AS p FROM md)),
chunk0 AS (
  SELECT book_id, pos, CASE WHEN pos > 0 THEN {sql_strip("split_part(part, chr(10), 1)")} END AS heading,
         {sql_strip("CASE WHEN pos > 0 THEN substr(part, length(split_part(part, chr(10), 1)) + 2) ELSE part END")} AS body
  FROM part),
chunk AS (SELECT *, row_number() OVER (PARTITION BY book_id, heading ORDER BY pos) AS nth FROM chunk0 WHERE body <> ''),
head AS (SELECT DISTINCT book_id, heading FROM chunk0 WHERE pos > 0),
line AS (SELECT book_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS t FROM (SELECT book_id, string_split(m, chr(10)) AS l FROM md)),
block AS (
  SELECT l.book_id, l.i, l.i // 3 AS page_idx, h.heading AS opens
  FROM line l LEFT JOIN head h ON h.book_id = l.book_id AND h.heading = {sql_strip("regexp_replace(l.t, '^# ', '')")}),
numbered AS (SELECT *, count(opens) OVER (PARTITION BY book_id ORDER BY i) AS section_no FROM block),
section AS (SELECT book_id, section_no, max(opens) AS heading, list_sort(list(DISTINCT page_idx)) AS pages FROM numbered GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY book_id, heading ORDER BY section_no) AS nth FROM section)
SELECT c.book_id, c.pos AS chunk_pos, coalesce(c.heading, '(none)') AS heading, md5(c.body) AS digest,
       coalesce(array_to_string(p.pages, '|'), '') AS page_numbers
FROM chunk c LEFT JOIN placed p ON p.book_id = c.book_id AND p.heading IS NOT DISTINCT FROM c.heading AND p.nth = c.nth
"""


def chunk_id_assign(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("collection"), "doc_id")
    return plain(chunking.assign_chunk_ids(docs, ["doc_id"]))


def _files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/books/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select("doc_id", path.alias("path"), routing.top_folder(path, "/books").alias("folder"), routing.depth_below(path, "/books").alias("depth"))


def _mapping(spark, sf_dir):
    """Folders named src1.. that end in 1 are shared by two collections, as written options."""
    folders = table(spark, sf_dir, "documents").select("source").distinct().filter(F.col("source").endswith("1"))
    option = F.concat("source", F.lit(": shared_a, "), F.col("source"), F.lit("_own"))
    return folders.select(routing.parse_mapping(option).alias("m")).select("m.*")


def collection_plan(spark, sf_dir):
    plan = routing.collection_plan(_files(spark, sf_dir), _mapping(spark, sf_dir), exact_depth=2)
    return plain(routing.plan_summary(plan))


def file_fan_out(spark, sf_dir):
    plan = routing.collection_plan(_files(spark, sf_dir), _mapping(spark, sf_dir))
    work = routing.distinct_files(plan).withColumn("work", F.md5("path")).select("path", "work")
    return plain(routing.fan_out(work, plan).groupBy("collection").agg(F.count(F.lit(1)).alias("files"), F.min("work").alias("first_work")))


SQL_PLAN = """
plan AS (
  SELECT doc_id, '/books/' || source || '/' || lang || '/' || doc_id || '.md' AS path,
         unnest(CASE WHEN ends_with(source, '1') THEN ['shared_a', source || '_own'] ELSE [source] END) AS collection
  FROM documents)
"""


def decode_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    rows = docs.select(
        "doc_id", F.concat_ws(",", (n % 7).cast("string"), F.lit(""), (n % 5).cast("string")).alias("page_numbers"),
        F.concat_ws("|||", F.concat(F.lit(" "), F.col("source"), F.lit(".png")), F.lit(""), "lang").alias("image_paths"),
        F.when(n % 3 > 0, F.col("source")).alias("book_title"), F.when(n % 2 > 0, F.col("lang")).alias("book_author"),
        F.when(n % 5 > 0, F.col("lang")).alias("section_heading"),
    )
    return plain(chunking.decode_metadata(rows))


def partition_books(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(F.lit("pdf"), F.lit("PDF"), F.lit("epub")), (F.col("doc_id") % 3 + 1).cast("int")).alias("extension"))
    parted = routing.partition_books(docs)
    return plain(parted.groupBy("success", F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("books")))


def highlights_located(spark, sf_dir):
    """Where the benchmark sentences stand in the linked documents."""
    pairs = links(spark, sf_dir).join(source_items(spark, sf_dir), "item_id")
    rows = pairs.select("item_id", "chunk_id", "text", F.explode(T.sentences("explanation")).alias("sentence"))
    start = F.position(F.col("sentence"), F.col("text")) - 1
    return plain(rows.filter(start >= 0).select("item_id", "chunk_id", "sentence", start.alias("start_char")))


QUERIES = {
    "quotable_top3": (quotable_top3, f"""
WITH {SQL_SCORED}
SELECT doc_id, quote_rank, sentence, round(score, 6) AS score, sentence_pos, start_char, start_char + length(sentence) AS end_char
FROM ranked WHERE quote_rank <= 3"""),
    "quote_dedup": (quote_dedup, f"""
WITH {SQL_SCORED}
SELECT source, doc_id, quote_rank, sentence FROM (
  SELECT *, row_number() OVER (PARTITION BY source, {sql_strip('lower(sentence)')} ORDER BY doc_id, quote_rank) AS rn
  FROM ranked WHERE quote_rank <= 3) WHERE rn = 1"""),
    "key_terms": (key_terms, f"""
SELECT doc_id, len(t)::BIGINT AS terms, len(list_distinct(t))::BIGINT AS distinct_terms, md5(array_to_string(t, ' ')) AS digest
FROM {_sql_terms_of(lex.KEY_TERM_STOP_WORDS)}"""),
    "concept_terms": (concept_terms, f"""
SELECT doc_id, len(t)::BIGINT AS terms, md5(array_to_string(t, ' ')) AS digest
FROM {_sql_terms_of(lex.CONCEPT_STOP_WORDS, "NOT regexp_full_match(z, '[0-9]+')")}"""),
    "sentence_stats": (sentence_stats, f"""
SELECT doc_id, len(s)::BIGINT AS sentences, len(list_filter(s, lambda z: length(z) BETWEEN 30 AND 200))::BIGINT AS usable,
       len({sql_words("array_to_string(s, ' ')")})::BIGINT AS words
FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)"""),
    "anchor_candidates": (anchor_candidates, f"""
SELECT doc_id, len(c)::BIGINT AS candidates, md5(array_to_string(c, chr(10))) AS digest FROM (
  SELECT doc_id, list_filter({sql_sentences('text')}, lambda z: length(z) BETWEEN 30 AND 200 AND NOT ends_with(z, '?')
    AND left(z, 1) NOT IN ('-', '•', '*', '–') AND (contains(lower(z), 'that') OR contains(lower(z), 'with')
    OR {sql_has('lower(z)', FACTUAL)})) AS c FROM documents)"""),
    "relevance": (relevance, f"""
WITH {SQL_SOURCE_ITEMS}, {SQL_LINKS},
p AS (SELECT l.item_id, l.chunk_id, lower(l.text) AS low, lower(i.learning_target) AS target, i.difficulty,
        list_distinct({sql_terms('i.learning_target', lex.KEY_TERM_STOP_WORDS)}) AS wanted,
        list_distinct({sql_terms('l.text', lex.KEY_TERM_STOP_WORDS)}) AS have
      FROM links l JOIN source_items i USING (item_id))
SELECT item_id, chunk_id, round(CASE WHEN len(wanted) = 0 THEN 0.5 ELSE least(1.0::DOUBLE,
    len(list_intersect(wanted, have))::DOUBLE / len(wanted)
    + CASE WHEN contains(low, target) THEN 0.2::DOUBLE ELSE 0 END
    + CASE WHEN contains(low, 'with') OR contains(low, 'pour') THEN 0.1::DOUBLE ELSE 0 END
    + CASE WHEN difficulty = 'advanced' AND (contains(low, 'from') OR contains(low, 'die')) THEN 0.1::DOUBLE
           WHEN difficulty = 'beginner' AND regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])(is|are)\\s+(a|an|the)($|[^\\p{{L}}\\p{{N}}_])') THEN 0.1 ELSE 0 END) END, 6) AS score
FROM p"""),
    "term_jaccard": (term_jaccard, f"""
WITH {SQL_SOURCE_ITEMS}, {SQL_LINKS},
p AS (SELECT l.item_id, l.chunk_id, list_distinct({sql_terms('l.text', lex.KEY_TERM_STOP_WORDS)}) AS a,
        list_distinct({sql_terms('i.explanation', lex.KEY_TERM_STOP_WORDS)}) AS b FROM links l JOIN source_items i USING (item_id))
SELECT item_id, chunk_id, round({sql_jaccard('a', 'b')}, 6) AS jaccard FROM p"""),
    "tag_similarity": (tag_similarity, f"""
WITH n AS (SELECT p_partkey, regexp_replace(lower(p_name || ' - ' || p_brand), '[\\s-]+', '_', 'g') AS a0,
                  regexp_replace(lower(p_type || '_' || p_name), '[\\s-]+', '_', 'g') AS b0 FROM part),
t AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(a0, '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') AS a,
             trim(regexp_replace(regexp_replace(b0, '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') AS b FROM n),
l AS (SELECT p_partkey, a, b, list_distinct(string_split(a, '_')) AS la, list_distinct(string_split(b, '_')) AS lb FROM t)
SELECT p_partkey, a AS tag, round(CASE WHEN a = b THEN 1.0::DOUBLE ELSE {sql_jaccard('la', 'lb')} END, 6) AS similarity FROM l"""),
    "names_sanitised": (names_sanitised, f"""
WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
SELECT page_id, {_sql_collection('url')} AS collection, {_sql_collection('title')} AS title_collection,
       {_sql_file('url', 100)} AS file, {_sql_file('title', 30)} AS short_file,
       trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
       lower(replace(title, ' ', '_')) AS entity_key,
       replace(replace(replace(replace(title, ' ', '_'), '/', '_'), '(', ''), ')', '') AS snapshot
FROM p"""),
    "match_normalise": (match_normalise, f"""
SELECT doc_id, length(n)::BIGINT AS chars, md5(n) AS digest FROM (
  SELECT doc_id, {sql_strip(f"lower(regexp_replace(regexp_replace(text, '{chr(92)}s+', ' ', 'g'), '[^{chr(92)}p{{L}}{chr(92)}p{{N}}_{chr(92)}s'']', '', 'g'))")} AS n FROM documents)"""),
    "content_hashes": (content_hashes, """
SELECT page_id, CASE WHEN page_id % 4 < 3 THEN md5(url) END AS hash FROM pages"""),
    "heading_chunks": (heading_chunks, f"""
WITH md AS (SELECT page_id, {SQL_MARKDOWN} AS m FROM pages),
part AS (SELECT page_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS part
         FROM (SELECT page_id, string_split(chr(10) || m, chr(10) || '# ') AS p FROM md)),
chunk AS (
  SELECT page_id, pos, CASE WHEN pos > 0 THEN {sql_strip("split_part(part, chr(10), 1)")} END AS heading,
         {sql_strip("CASE WHEN pos > 0 THEN substr(part, length(split_part(part, chr(10), 1)) + 2) ELSE part END")} AS body
  FROM part)
SELECT page_id, pos AS section_pos, coalesce(heading, '(none)') AS heading, length(body)::BIGINT AS chars, md5(body) AS digest,
       coalesce(array_to_string(regexp_extract_all(body, '!\\[.*?\\]\\((.+?)\\)', 1), ','), '') AS images
FROM chunk WHERE body <> ''"""),
    "chunk_pages": (chunk_pages, SQL_CHUNK_PAGES),
    "chunk_id_assign": (chunk_id_assign, """
SELECT source AS collection, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position,
       'chunk_' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS chunk_id FROM documents"""),
    "collection_plan": (collection_plan, f"WITH {SQL_PLAN} SELECT collection, count(*) AS books FROM plan GROUP BY 1"),
    "file_fan_out": (file_fan_out, f"WITH {SQL_PLAN} SELECT collection, count(*) AS files, min(md5(path)) AS first_work FROM plan GROUP BY 1"),
    "decode_metadata": (decode_metadata, """
SELECT doc_id, (doc_id % 7) || '|' || (doc_id % 5) AS page_numbers, source || '.png|' || lang AS image_paths,
       CASE WHEN doc_id % 3 > 0 THEN source ELSE 'Unknown' END AS book_title, CASE WHEN doc_id % 2 > 0 THEN lang ELSE 'Unknown' END AS book_author,
       CASE WHEN doc_id % 5 > 0 THEN lang ELSE '' END AS section_heading FROM documents"""),
    "partition_books": (partition_books, """
SELECT doc_id % 3 < 2 AS success, CASE WHEN doc_id % 3 < 2 THEN '' ELSE 'Unsupported format: epub' END AS error, count(*) AS books
FROM documents GROUP BY 1, 2"""),
    "highlights_located": (highlights_located, f"""
WITH {SQL_SOURCE_ITEMS}, {SQL_LINKS},
s AS (SELECT l.item_id, chunk_id, text, unnest({sql_sentences('i.explanation')}) AS sentence FROM links l JOIN source_items i USING (item_id))
SELECT item_id, chunk_id, sentence, position(sentence IN text) - 1 AS start_char FROM s WHERE contains(text, sentence)"""),
}

