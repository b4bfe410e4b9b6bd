"""Queries over vectors, retrieval and matching tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SQL_LINKS, SQL_SOURCE_ITEMS, links, plain, source_items, sql_words, table
from catalog.texts import LEXICON, SQL_SCORED
from lectern.functions import text as T
from lectern.operators import catalogue, images, item_plans, metrics, retrieval
from lectern.operators import quotes as Q


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("collection"), F.col("embedding").alias("vector"))


def _queries(spark, sf_dir):
    return _chunks(spark, sf_dir).withColumnRenamed("chunk_id", "query_id")


def vector_topk(spark, sf_dir):
    return plain(retrieval.vector_topk(_queries(spark, sf_dir), _chunks(spark, sf_dir), 5))


def vector_topk_grid(spark, sf_dir):
    """The same by cosine and in slices, the way taken when the queries are too many to send at once."""
    return plain(retrieval.vector_topk(_queries(spark, sf_dir), _chunks(spark, sf_dir), 5, "cosine", broadcast_bytes=1_000_000))


SQL_L2 = """
hit AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, pow(list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 2) AS distance
  FROM embeddings q JOIN embeddings c ON q.label = c.label),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM hit)
"""


def multi_query_merge(spark, sf_dir):
    """Items with two queries, their own vector and the opposite one; each chunk once per item."""
    own = _queries(spark, sf_dir)
    both = own.select((F.col("query_id") * 2).alias("query_id"), "collection", "vector", F.col("query_id").alias("item_id"), F.lit(0).alias("query_pos")).unionByName(
        own.select((F.col("query_id") * 2 + 1).alias("query_id"), "collection", F.transform("vector", lambda x: -x).alias("vector"), F.col("query_id").alias("item_id"), F.lit(1).alias("query_pos"))
    )
    hits = retrieval.vector_topk(both, _chunks(spark, sf_dir), 20).join(both.select("query_id", "item_id", "query_pos"), "query_id")
    return plain(retrieval.merge_hits(hits.drop("query_id")).select("item_id", "chunk_id", "distance"))


def _retrieval_inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    vectors = _chunks(spark, sf_dir)
    chunks = vectors.join(docs, "chunk_id")
    items = vectors.select(
        F.col("chunk_id").alias("item_id"), F.lit("that with from").alias("learning_target"),
        F.when(F.col("chunk_id") % 3 == 0, T.words_array(["Pour"])).otherwise(T.words_array(["the"])).alias("must_include"),
    )
    rows = vectors.withColumn("item_id", F.col("chunk_id")).drop("chunk_id")
    precise = rows.select((F.col("item_id") * 2).alias("query_id"), F.lit(0).alias("query_pos"), "item_id", F.lit("high_precision").alias("intent"), "collection", "vector")
    broad = rows.select((F.col("item_id") * 2 + 1).alias("query_id"), F.lit(1).alias("query_pos"), "item_id", F.lit("synonym_variant").alias("intent"), "collection", F.transform("vector", lambda x: -x).alias("vector"))
    return items, precise.unionByName(broad), chunks


def _two_rounds(spark, sf_dir):
    items, queries, chunks = _retrieval_inputs(spark, sf_dir)
    return Q.two_round_quotes(items, queries, chunks, min_quotes=3, k_round1=3, k_round2=6, persist=retrieval_checkpoint, **LEXICON)


def retrieval_checkpoint(df):
    from lectern.operators.durable import durable

    return durable(df)


def two_round_status(spark, sf_dir):
    _, status = _two_rounds(spark, sf_dir)
    return plain(status.select("item_id", "status", "retrieval_rounds", "chunks_searched", "quotes_found", F.array_sort("keywords_missing").alias("keywords_missing")))


def two_round_quotes(spark, sf_dir):
    quotes, _ = _two_rounds(spark, sf_dir)
    return plain(quotes.select("item_id", "quote_id", "chunk_id", "chunk_index", "sentence", "score", "start_char", "end_char", "place"))


# target words of "that with from" without the short stop list: none is left, so no bonus
SQL_ROUNDS = f"""
WITH {SQL_SCORED},
q AS (SELECT vec_id AS item_id, label, 0 AS query_pos, embedding::DOUBLE[] AS v FROM embeddings
      UNION ALL SELECT vec_id, label, 1, list_transform(embedding::DOUBLE[], lambda z: -z) FROM embeddings),
hit AS (SELECT q.item_id, q.query_pos, c.vec_id AS chunk_id, pow(list_distance(q.v, c.embedding::DOUBLE[]), 2) AS distance FROM q JOIN embeddings c USING (label)),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id, query_pos ORDER BY distance, chunk_id) AS rank FROM hit),
word AS (SELECT vec_id AS item_id, CASE WHEN vec_id % 3 = 0 THEN 'pour' ELSE 'the' END AS w FROM embeddings),
pool AS (
  SELECT 1 AS round, item_id, chunk_id, min(distance) AS distance, min(query_pos * 1000 + rank) AS seen FROM top WHERE query_pos = 0 AND rank <= 3 GROUP BY 2, 3
  UNION ALL SELECT 2, item_id, chunk_id, min(distance), min(query_pos * 1000 + rank) FROM top WHERE rank <= 6 GROUP BY 2, 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY round, item_id ORDER BY distance, seen) - 1 AS chunk_index FROM pool),
quote AS (SELECT p.*, r.quote_rank, r.sentence, r.score, r.start_char FROM placed p JOIN ranked r ON r.doc_id = p.chunk_id AND r.quote_rank <= 3),
key AS (SELECT p.round, p.item_id, count(DISTINCT p.chunk_id) AS chunks, max(contains(lower(d.text), w.w)::INT) AS has_key
        FROM placed p JOIN documents d ON d.doc_id = p.chunk_id JOIN word w USING (item_id) GROUP BY 1, 2),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, trim(lower(sentence)) ORDER BY seen, quote_rank) AS rn FROM quote WHERE round = 1) WHERE rn = 1),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, trim(lower(sentence)) ORDER BY round, seen, quote_rank) AS rn FROM quote) WHERE rn = 1),
n1 AS (SELECT item_id, count(*) AS n FROM one GROUP BY 1),
n2 AS (SELECT item_id, count(*) AS n FROM two GROUP BY 1),
state AS (
  SELECT e.vec_id AS item_id, w.w, coalesce(n1.n, 0) AS a, coalesce(n2.n, 0) AS b, k1.chunks AS c1, k2.chunks AS c2, k1.has_key AS h1, k2.has_key AS h2,
         coalesce(n1.n, 0) >= 3 AND coalesce(k1.has_key, 0) = 1 AS done
  FROM embeddings e JOIN word w ON w.item_id = e.vec_id LEFT JOIN n1 ON n1.item_id = e.vec_id LEFT JOIN n2 ON n2.item_id = e.vec_id
  LEFT JOIN key k1 ON k1.round = 1 AND k1.item_id = e.vec_id LEFT JOIN key k2 ON k2.round = 2 AND k2.item_id = e.vec_id),
status AS (
  SELECT item_id, done, CASE WHEN done OR b >= 3 THEN 'sufficient' WHEN b > 0 THEN 'marginal' ELSE 'insufficient' END AS status,
         CASE WHEN done THEN 1 ELSE 2 END::BIGINT AS retrieval_rounds, coalesce(CASE WHEN done THEN c1 ELSE c2 END, 0) AS chunks_searched,
         CASE WHEN done THEN a ELSE b END AS quotes_found, CASE WHEN done OR coalesce(h2, 0) = 1 THEN '' ELSE w END AS keywords_missing FROM state),
final AS (SELECT o.* FROM one o JOIN status USING (item_id) WHERE done UNION ALL SELECT t.* FROM two t JOIN status USING (item_id) WHERE NOT done),
counted AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round, seen, quote_rank) AS discovered FROM final),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, discovered) AS place FROM counted)
"""


def fetch_by_ids(spark, sf_dir):
    """Stored chunks of the ids in an item; ids past the last document cannot be found."""
    n = table(spark, sf_dir, "documents").count()
    items = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.array((F.col("doc_id") * 2), (F.col("doc_id") * 3 + n)).alias("chunk_ids")
    )
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    found = retrieval.fetch_chunks(items, chunks).select("item_id", "chunk_id", "source", F.lit("found").alias("state"))
    gone = retrieval.unretrievable(items, chunks).select("item_id", F.lit(-1).cast("long").alias("chunk_id"), F.col("rule_name").alias("source"), F.col("severity").alias("state"))
    return plain(found.unionByName(gone))


def items_without_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    hits = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"))
    return plain(retrieval.items_without_hits(docs, hits))


def missing_supports(spark, sf_dir):
    plans = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.array(*[F.struct(F.concat(F.lit("Q"), (F.col("doc_id") % m).cast("string")).alias("quote_id")) for m in (3, 4)]).alias("support_mapping")
    )
    quotes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.explode(T.words_array(["Q1", "Q2"])).alias("quote_id"))
    return plain(item_plans.missing_supports(plans, quotes))


def catalogue_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    wanted = part.select(F.col("p_partkey").alias("book_id"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_name")).otherwise("unknown").alias("title"), F.when(F.col("p_partkey") % 5 > 0, F.lower("p_brand")).otherwise("").alias("author"))
    hits = part.select(F.col("p_name").alias("title"), F.col("p_partkey").alias("hit_pos"), F.col("p_partkey").alias("hit_id"), F.concat(F.lit("by "), F.col("p_brand")).alias("hit_author"))
    return plain(catalogue.match_books(wanted, hits))


def _image_inputs(spark, sf_dir):
    rows = links(spark, sf_dir)
    chunks = rows.select(
        "item_id", "chunk_pos", ((F.col("chunk_id") * 7 % 100) / 100).alias("distance"),
        F.array(F.concat(F.lit("images/"), F.col("source"), F.lit(".png")), F.concat(F.lit("pics/"), F.col("lang"), F.lit(".jpg"))).alias("image_paths"),
    )
    notes = rows.select(
        F.col("chunk_id").alias("annotation_pos"),
        F.when(F.col("chunk_id") % 3 == 0, F.concat("source", F.lit(".png"))).when(F.col("chunk_id") % 3 == 1, F.concat(F.lit("old/"), F.col("lang"), F.lit(".jpg"))).otherwise(F.concat(F.lit("images/"), F.col("source"), F.lit(".png"))).alias("path"),
        F.array_join(T.split_words("text"), " ").alias("description"),
    )
    return chunks, source_items(spark, sf_dir), notes


def best_images(spark, sf_dir):
    chunks, items, notes = _image_inputs(spark, sf_dir)
    return plain(images.best_images(chunks, items, notes))


def nearest_images(spark, sf_dir):
    chunks, items, _ = _image_inputs(spark, sf_dir)
    return plain(images.best_images(chunks, items))


SQL_IMAGES = f"""
{SQL_SOURCE_ITEMS}, {SQL_LINKS},
shown AS (
  SELECT item_id, chunk_pos, (chunk_id * 7 % 100) / 100 AS distance, unnest(['images/' || source || '.png', 'pics/' || lang || '.jpg']) AS path, unnest([0, 1]) AS image_pos FROM links),
image AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, path ORDER BY chunk_pos, image_pos) AS rn FROM shown) WHERE rn = 1)
"""

SQL_NOTES = f"""
note0 AS (
  SELECT chunk_id AS pos, CASE chunk_id % 3 WHEN 0 THEN source || '.png' WHEN 1 THEN 'old/' || lang || '.jpg' ELSE 'images/' || source || '.png' END AS path,
         array_to_string({sql_words('text')}, ' ') AS description FROM links),
note AS (SELECT path, max(pos) AS pos, arg_max(description, pos) AS description FROM note0 WHERE description <> '' GROUP BY 1),
name AS (SELECT DISTINCT path, split_part(path, '/', 2) AS file FROM image),
described AS (
  SELECT n.path, coalesce(
    (SELECT description FROM note x WHERE x.path = n.path),
    (SELECT description FROM note x WHERE n.path LIKE 'images/%' AND x.path = substr(n.path, 8)),
    (SELECT arg_min(description, pos) FROM note x WHERE ends_with(x.path, n.file)), 'No description') AS description FROM name n)
"""


def citation_merge(spark, sf_dir):
    used = links(spark, sf_dir).select(
        "item_id", "chunk_pos", F.col("source").alias("book_title"), F.col("lang").alias("book_author"),
        F.array((F.col("chunk_id") % 4).cast("int"), (F.col("chunk_id") % 3 + 4).cast("int")).alias("pages"),
    )
    merged = metrics.merge_citations(used, first=5)
    return plain(merged.select("item_id", F.posexplode("citations").alias("place", "c")).select("item_id", "place", "c.book_title", "c.book_author", "c.pages"))


QUERIES = {
    "vector_topk": (vector_topk, f"WITH {SQL_L2} SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM top WHERE rank <= 5"),
    "vector_topk_grid": (vector_topk_grid, """
WITH hit AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance
             FROM embeddings q JOIN embeddings c ON q.label = c.label),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id = chunk_id THEN 0 ELSE distance END, chunk_id) AS rank FROM hit)
SELECT query_id, chunk_id, round(abs(distance), 6) AS distance, rank FROM top WHERE rank <= 5"""),
    "multi_query_merge": (multi_query_merge, """
WITH q AS (SELECT vec_id AS item_id, label, 0 AS p, embedding::DOUBLE[] AS v FROM embeddings UNION ALL
           SELECT vec_id, label, 1, list_transform(embedding::DOUBLE[], lambda z: -z) FROM embeddings),
hit AS (SELECT item_id, p, c.vec_id AS chunk_id, pow(list_distance(q.v, c.embedding::DOUBLE[]), 2) AS distance FROM q JOIN embeddings c USING (label)),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id, p ORDER BY distance, chunk_id) AS rank FROM hit)
SELECT item_id, chunk_id, round(min(distance), 6) AS distance FROM top WHERE rank <= 20 GROUP BY 1, 2"""),
    "two_round_status": (two_round_status, f"{SQL_ROUNDS} SELECT item_id, status, retrieval_rounds, chunks_searched, quotes_found, keywords_missing FROM status"),
    "two_round_quotes": (two_round_quotes, f"""
{SQL_ROUNDS} SELECT item_id, 'Q' || discovered AS quote_id, chunk_id, chunk_index, sentence, round(score, 6) AS score, start_char, start_char + length(sentence) AS end_char, place
FROM best JOIN status USING (item_id) WHERE status <> 'sufficient' OR place <= 6"""),
    "fetch_by_ids": (fetch_by_ids, """
WITH w AS (SELECT doc_id AS item_id, unnest([doc_id * 2, doc_id * 3 + (SELECT count(*) FROM documents)]) AS chunk_id FROM documents),
f AS (SELECT w.item_id, w.chunk_id, d.source FROM w JOIN documents d ON d.doc_id = w.chunk_id)
SELECT *, 'found' AS state FROM f UNION ALL
SELECT doc_id, -1, 'source_chunks_retrievable', 'minor' FROM documents WHERE doc_id NOT IN (SELECT item_id FROM f)"""),
    "items_without_hits": (items_without_hits, "SELECT doc_id AS item_id, false AS success, 'No relevant chunks found' AS error FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "missing_supports": (missing_supports, """
WITH s AS (SELECT doc_id AS item_id, unnest([0, 1])::BIGINT AS support_pos, unnest(['Q' || doc_id % 3, 'Q' || doc_id % 4]) AS quote_id FROM documents)
SELECT item_id, support_pos, quote_id FROM s WHERE NOT (quote_id IN ('Q1', 'Q2') AND item_id IN (SELECT doc_id FROM labels))"""),
    "catalogue_match": (catalogue_match, """
WITH w AS (SELECT p_partkey AS book_id, CASE WHEN p_partkey % 9 > 0 THEN p_name ELSE 'unknown' END AS title, CASE WHEN p_partkey % 5 > 0 THEN lower(p_brand) ELSE '' END AS author FROM part),
h AS (SELECT p_name AS title, p_partkey AS hit_id, 'by ' || p_brand AS hit_author FROM part),
r AS (SELECT w.*, h.hit_id, h.hit_author, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN author <> '' AND contains(lower(hit_author), author) THEN 0 ELSE 1 END, hit_id) AS rn
      FROM w LEFT JOIN h USING (title))
SELECT book_id, title, author, hit_id, hit_author, hit_id IS NOT NULL AS found FROM r WHERE rn = 1"""),
    "best_images": (best_images, f"""
WITH {SQL_IMAGES}, {SQL_NOTES},
s AS (SELECT i.*, CASE WHEN d.description = 'No description' OR t.learning_target = '' THEN distance
        ELSE distance * 0.1::DOUBLE - len(list_intersect(list_distinct({sql_words('lower(t.learning_target)')}), list_distinct({sql_words('lower(d.description)')}))) END AS score
      FROM image i JOIN described d USING (path) JOIN source_items t USING (item_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score, chunk_pos, image_pos) AS place FROM s)
SELECT item_id, place, path, round(score, 6) AS score FROM p WHERE place <= 3"""),
    "nearest_images": (nearest_images, f"""
WITH {SQL_IMAGES}, p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, chunk_pos, image_pos) AS place FROM image)
SELECT item_id, place, path, round(distance, 6) AS score FROM p WHERE place <= 3"""),
    "citation_merge": (citation_merge, """
WITH u AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS item_id, doc_id // (SELECT count(*) FROM benchmark) AS pos, source, lang, doc_id FROM documents),
f AS (SELECT * FROM u WHERE pos < 5),
b AS (SELECT item_id, source, lang, min(pos) AS first_pos FROM f GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY first_pos) - 1 AS place, row_number() OVER (PARTITION BY item_id, source ORDER BY first_pos) AS same_title FROM b),
g AS (SELECT f.item_id, f.pos, unnest([f.doc_id % 4, f.doc_id % 3 + 4]) AS page, unnest([0, 1]) AS k, CASE WHEN f.pos = n.first_pos THEN n.place ELSE t.place END AS place
      FROM f JOIN n USING (item_id, source, lang) JOIN n t ON t.item_id = f.item_id AND t.source = f.source AND t.same_title = 1),
o AS (SELECT item_id, place, page, min(pos * 2 + k) AS seen FROM g GROUP BY 1, 2, 3)
SELECT o.item_id, o.place, n.source AS book_title, n.lang AS book_author, string_agg(page::VARCHAR, '|' ORDER BY seen) AS pages
FROM o JOIN n USING (item_id, place) GROUP BY 1, 2, 3, 4"""),
}
