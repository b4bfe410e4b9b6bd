import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import lexicon as lex
from lectern.functions.fuzzy import may_reach, reached_similarity, window_similarity
from lectern.operators import anchors, chunking, learner, novelty, quotes, retrieval
from lectern.operators.durable import numbered

BOOK = "book_id string, markdown string, blocks array<struct<text:string,page_idx:int>>, book_title string, book_author string, source_file string"


@pytest.mark.parametrize("markdown, blocks, wanted", [
    ("# Words\nFirst\n# Other\nx\n# Words\nSecond", [("Words", 5), ("First", 5), ("First more", 6), ("Other", 10), ("Words", 50), ("Second", 51)],
     [("Words", [5, 6]), ("Other", [10]), ("Words", [50, 51])]),
    ("Intro\n# One\nbody", [("Intro", 1), ("More", 2), ("One", 3)], [(None, [1, 2]), ("One", [3])]),
    ("# Heading\nContent", [], [("Heading", [])]),
    ("# A\n# B\ntext\n# A\nmore", [("A", 1), ("B", 2), ("A", 3)], [("B", [2]), ("A", [1])]),  # an empty section uses no occurrence
    ("# Chapter\nContent", [("Chapter", 5), ("Content", 5), ("More", 7), ("Text", 6), ("Final", 7), (None, None)], [("Chapter", [5, 6, 7])]),
    ("# My Heading\nContent", [("Different text", 1), ("Other", 2)], [("My Heading", [])]),
])
def test_chunk_books(spark, markdown, blocks, wanted):
    df = spark.createDataFrame([("b", markdown, blocks, "T", "A", "f")], BOOK)
    rows = chunking.chunk_books(df).orderBy("chunk_pos").collect()
    assert [(r.section_heading, r.page_numbers) for r in rows] == wanted


def test_numbered_spreads_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), (F.col("id") * 7919 % 3001).alias("k"))
    got = numbered(df, ["g"], ["k"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.k, r.position))
    assert len(got) == 3000
    for rows in groups.values():
        assert [p for _, p in sorted(rows)] == list(range(len(rows)))


def test_grid_equals_broadcast(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("collection"), F.col("embedding").alias("vector"))
    queries = chunks.withColumnRenamed("chunk_id", "query_id")
    a = retrieval.vector_topk(queries, chunks, 4).orderBy("query_id", "rank").collect()
    b = retrieval.vector_topk(queries, chunks, 4, broadcast_bytes=4096, cells=500).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.rank) for r in a] == [(r.query_id, r.chunk_id, r.rank) for r in b]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_so_far_equals_all_distances(metric):
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((12, 6)) * 20
    vectors = centres[draw.integers(0, 12, 3000)] + draw.standard_normal((3000, 6)) * 0.1
    vectors[100:200] = vectors[0]  # ties
    queries = np.concatenate([vectors[:40], draw.standard_normal((10, 6))])
    ids = np.array([f"c{i:04d}" for i in draw.permutation(3000)], object)
    best = retrieval.NearestSoFar(queries, 7, metric, cells=900)
    peak = []
    real = best._compare
    best._compare = lambda which, near, names, slack: (peak.append(len(which) * len(near)), real(which, near, names, slack))
    for start in range(0, 3000, 500):
        best.show(vectors[start:start + 500], ids[start:start + 500])
    assert max(peak) <= 900 and best.worked_out < 0.7 * len(queries) * len(vectors)  # far groups are passed over
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True) if metric == "cosine" else m
    far = ((unit(queries)[:, None, :] - unit(vectors)[None, :, :]) ** 2).sum(axis=2)
    for q in range(len(queries)):
        want = sorted(zip(far[q].round(10), ids))[:7]
        own = best.at == q
        assert [(d, i) for d, i in zip(best.distances[own].round(10), best.ids[own])] == want


def test_tiles_hold_their_budget():
    for n, m, cells in ((5, 7, 1), (100, 3, 50), (1, 1000, 64), (0, 5, 10), (1000, 1000, 10_000)):
        seen = np.zeros((n, m), int)
        for q, v in retrieval.tiles(n, m, cells):
            assert (q.stop - q.start) * (v.stop - v.start) <= cells
            seen[q, v] += 1
        assert (seen == 1).all()


def test_chunks_are_not_shuffled(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("label").cast("string").alias("collection"), F.col("embedding").alias("vector"))
    hits = retrieval.vector_topk(e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "chunk_id"), 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below


# --- novelty against the plain walk ---------------------------------------------------------------


def concept_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = "alpha beta1 gamma delta omega kappa sigma theta lambda zetas first airway shock".split()
    base = [rng.sample(vocabulary, rng.randint(1, 6)) for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        if rng.random() < 0.4:
            words.append(rng.choice(vocabulary))
        rows.append((i, f"i{i}", rng.choice(["Tag one", "tag-one two", "", "other"]), " ".join(words)))
    return rows


def norm(tag):
    tag = re.sub(r"[\s\-]+", "_", tag.lower())
    return re.sub("_+", "_", re.sub(r"[^a-z0-9_]", "", tag)).strip("_")


def jac(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def walk(rows, threshold):
    stop, kept, out = set(lex.CONCEPT_STOP_WORDS), [], {}
    for _, name, tag, target in rows:
        tag = norm(tag or target[:50])
        terms = [w for w in re.findall(r"\w+", target.lower()) if len(w) > 3 and w not in stop and not w.isdigit()]
        best, best_tag = 0.0, None
        for other, words in kept:
            tags = 1.0 if tag == other else jac(tag.split("_"), other.split("_"))
            value = tags * 0.4 + jac(terms, words) * 0.6
            if value > best:
                best, best_tag = value, other
        if best < threshold:
            kept.append((tag, terms))
            out[name] = (False, None, None)
        else:
            out[name] = (True, best_tag, round(best, 6))
    return out


@pytest.mark.parametrize("threshold, head", [(0.85, 64), (0.7, 3), (0.35, 64)])
def test_greedy_dedup_equals_the_walk(spark, threshold, head):
    rows = concept_rows(3, 60)
    df = spark.createDataFrame(rows, "pos int, item_id string, concept_tag string, learning_target string")
    got = novelty.greedy_dedup(df, threshold, head=head).collect()
    found = {r.item_id: (r.is_duplicate, r.duplicate_of, None if r.similarity_score is None else round(r.similarity_score, 6)) for r in got}
    assert found == walk(rows, threshold)


def test_soft_novelty_with_a_hot_cluster(spark):
    rows = [(i, f"i{i}", "same words in every copy of this stem" + (f" extra{i}" if i % 4 == 0 else ""), "answer") for i in range(50)]
    df = spark.createDataFrame(rows, "pos int, item_id string, stem string, correct_answer string")
    got = {r.item_id: r.similar_item_id for r in novelty.soft_novelty(df, 0.7, head=2).collect()}
    for n, (_, name, stem, answer) in enumerate(rows):
        words = set(stem.split() + answer.split())
        first = next((r[1] for r in rows[:n] if jac(words, set(r[2].split() + r[3].split())) > 0.7), None)
        assert got[name] == first


# --- anchors against the plain walk ---------------------------------------------------------------------


def test_anchor_selection(spark):
    chunks = [
        ("i", "c0", 0, "You should always assess breathing before moving anyone. Nothing else."),
        ("i", "c1", 1, "Bleeding control is a critical skill that must be practised. The airway should always be assessed first of all."),
        ("i", "c2", 2, "The airway and the breathing should always be assessed by the crew. Other text here."),
        ("j", "c0", 0, "No word of the target stands in this text, yet it should be long."),
    ]
    items = spark.createDataFrame([("i", "airway breathing bleeding", "advanced"), ("j", "spinal precautions", "beginner")], "item_id string, learning_target string, difficulty string")
    links = spark.createDataFrame(chunks, "item_id string, chunk_id string, chunk_pos int, text string")
    got = anchors.select_anchors(items, links).orderBy("anchor_no").collect()
    assert [(r.item_id, r.chunk_id) for r in got] == [("i", "c1"), ("i", "c2")] or [(r.item_id, r.chunk_id) for r in got] == [("i", "c2"), ("i", "c1")]
    assert got[-1].coverage == pytest.approx(1.0)
    summary = {r.item_id: (r.anchors, r.enough) for r in anchors.anchor_summary(items, anchors.select_anchors(items, links)).collect()}
    assert summary == {"i": (2, True), "j": (0, False)}


def test_fuzzy_quotes(spark):
    texts = spark.createDataFrame([("a", "The crew shovld wait for the power company now.", None)], "item_id string, generated_text string, required_quote_ids array<string>")
    rows = [("a", "Q1", "The crew should wait for the power company"), ("a", "Q2", "An entirely different sentence of words"), ("a", "Q3", "for the POWER company!")]
    df = spark.createDataFrame(rows, "item_id string, quote_id string, text string")
    got = quotes.verify_quotes(texts, df).first()
    assert window_similarity(rows[0][2].lower(), "the crew shovld wait for the power company now.") >= 0.85
    assert (got.exact_match_count, got.fuzzy_match_count, got.missing_quote_ids, got.all_required_found) == (0, 2, ["Q2"], False)


def test_seeded_search_equals_every_window(spark):
    draw = random.Random(5)
    rows = [("", "abc"), ("abc", ""), ("é" * 20, "é" * 19 + "x"), ("abcdefghij" * 3, "abcdefghij" * 2)]
    for _ in range(600):
        text = "".join(draw.choices("abcé ", k=draw.randint(1, 90)))
        start, n = draw.randrange(len(text)), draw.randint(1, 40)
        needle = "".join(draw.choice("abx") if draw.random() < 0.12 else c for c in text[start:start + n])
        rows.append((needle + "zz" * draw.randint(0, 1), text))
    df = spark.createDataFrame(rows, "needle string, haystack string")
    for least in (0.5, 0.85, 0.95, 1.0):
        seeds = [r[0] for r in df.select(may_reach("needle", "haystack", least)).collect()]
        found = 0
        for (needle, haystack), seed in zip(rows, seeds, strict=True):
            best = window_similarity(needle, haystack)
            want = best if best >= least else 0.0
            assert reached_similarity(needle, haystack, least) == want
            assert seed or not want
            found += want > 0
        assert 20 < found < len(rows)


def test_sessions_do_not_depend_on_buckets(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(
        F.lit(1).alias("learner_id"), "ts", (F.col("event_type") != "error").alias("is_correct"), F.lit(3).alias("confidence"), F.col("value").alias("seconds")
    )
    a = learner.review_sessions(e, 3600, 86400).orderBy("session_no").collect()
    b = learner.review_sessions(e, 3600, 5400).orderBy("session_no").collect()
    assert [(r.session_start, r.items, r.correct) for r in a] == [(r.session_start, r.items, r.correct) for r in b]
    assert len(a) > 1
