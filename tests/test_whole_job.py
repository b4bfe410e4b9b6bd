"""Queries and operators over whole inputs, against plain Python or their SQL."""

import random
import re

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.check import compare, connect
from lectern.functions import lexicon as lex
from lectern.operators import novelty

VECTOR_CONCEPT = "pos int, tag string, terms array<string>, embedding array<float>"


def check(spark, new, registry, threshold, **more):
    frame = lambda rows: spark.createDataFrame(rows, VECTOR_CONCEPT)
    return {r.pos: r for r in novelty.check_novelty(frame(new), frame(registry), threshold, vectors=True, **more).collect()}


def test_a_near_vector_is_enough(spark):
    """Cosine 1 and nothing shared scores 0.5."""
    new = [(1, "one", ["alpha"], [1.0, 2.0, 3.0]), (2, "one", ["alpha"], [-1.0, 2.0, 3.0]), (3, "two", ["omega"], None), (4, "two", ["omega"], None)]
    registry = [(8, "other", ["gamma"], [0.0, 0.0, 0.0]), (9, "other", ["delta"], [1.0, 2.0, 3.0]), (10, "two", ["omega"], None), (11, "long", ["kappa"], [1.0, 2.0, 3.0, 4.0])]
    got = check(spark, new, registry, 0.5)
    assert not got[1].is_novel and got[1].similarity_score == pytest.approx(0.5) and got[1].similar_tag == "other"
    assert got[2].is_novel and got[2].similarity_score == pytest.approx(0.5 * 12 / 14) and got[2].similar_tag is None and got[2].similar_terms == []
    assert not got[3].is_novel and got[3].similarity_score == got[4].similarity_score == 1.0  # no vector: words and tag count alone


def test_nothing_alike_scores_zero(spark):
    new = [(1, "one", ["alpha"], [1.0]), (2, "one", [], None)]
    assert [(r.is_novel, r.similarity_score) for r in check(spark, new, [], 0.5).values()] == [(True, 0.0)] * 2
    assert [(r.is_novel, r.similarity_score) for r in check(spark, new, [(9, "two", ["beta"], [-1.0])], 0.5).values()] == [(True, 0.0)] * 2
    assert check(spark, [], new, 0.5) == {}


WORDS = "alpha gamma delta omega kappa sigma".split()


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0


def all_pairs(a, b):
    """Score of (pos, tag, terms, vector) against another."""
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    score = (1.0 if a[1] == b[1] else jaccard(a[1].split("_"), b[1].split("_"))) * 0.4 + jaccard(a[2], b[2]) * 0.6
    return score if a[3] is None or b[3] is None else score / 2 + dot(a[3], b[3]) / (dot(a[3], a[3]) * dot(b[3], b[3])) ** 0.5 / 2


def made(seed, n=60):
    rng = random.Random(seed)
    return [(i, "_".join(rng.sample("abcdef", rng.randint(1, 2))), sorted(rng.sample(WORDS, rng.randint(0, 3))), rng.choice([None, [rng.uniform(-0.3, 1) for _ in range(3)]])) for i in range(n)]


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.6, 0.75, 0.9])
def test_vector_novelty_is_the_best_of_all_pairs(spark, threshold):
    rows = made(3)
    got = check(spark, rows[::2], rows[1::2], threshold)
    few = check(spark, rows[::2], rows[1::2], threshold, score_novel=False)
    for row in rows[::2]:
        best = max(all_pairs(row, other) for other in rows[1::2])
        assert got[row[0]].is_novel == few[row[0]].is_novel == (best < threshold)
        assert got[row[0]].similarity_score == pytest.approx(max(best, 0), abs=1e-6)
        assert few[row[0]].similarity_score == (pytest.approx(best, abs=1e-6) if best >= threshold else None)
        assert got[row[0]].similar_tag == few[row[0]].similar_tag


def test_many_blocks_give_what_one_gives(spark):
    rows = made(4, 90)
    frame = lambda of, name: spark.createDataFrame(of, VECTOR_CONCEPT).withColumnRenamed("pos", name)
    left, right = frame(rows[::2], "n_id"), frame(rows[1::2], "r_id")
    one, many = ({r.n_id: r.r_id for r in novelty._best_in_blocks(left, right, True, budget).collect()} for budget in (10**6, 60))
    assert one == many and len(one) == 45
    score = {(a[0], b[0]): round(all_pairs(a, b), 12) for a in rows[::2] for b in rows[1::2]}
    assert one == {a[0]: min((-score[a[0], b[0]], b[0]) for b in rows[1::2])[1] for a in rows[::2]}


@pytest.mark.parametrize("name", ["novelty_vectors", "novelty_check", "greedy_dedup", "soft_novelty"])
def test_new_queries_match_sql(spark, sf, name):
    line = compare(spark, connect(sf), sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert line.endswith("ok"), line


# --- whole texts against all pairs ------------------------------------------------------------------


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Texts that agree in the first words only, and texts that agree in all but the first words."""
    rng = random.Random(5)
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnopqr"]
    body = [[" ".join(rng.sample(words, 40)) for _ in range(2)] for _ in range(4)]
    start = [" ".join(rng.sample(words, 30)) for _ in range(2)]
    texts = [f"{start[i % 2]} {body[i % 4][i % 3 % 2]} {' '.join(rng.sample(words, i % 5))}" for i in range(24)]
    texts += [f"opening{i} stands before all others number{i} here again more than twelve words are used up {body[1][0]}" for i in range(6)]
    texts += [" ".join(f"other{i}x{n}word" for n in range(20)) for i in range(4)]
    folder = str(tmp_path_factory.mktemp("alike"))
    rows = [(i, t, "en", "src1" if i % 7 else "src2", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def similar(a, b):
    terms = lambda t: {w for w in re.findall(r"\w{4,}", t.lower()) if w not in lex.CONCEPT_STOP_WORDS and not w.isdigit()}
    tags = 1.0 if a[3] == b[3] else jac({"en", a[3]}, {"en", b[3]})
    return tags * 0.4 + jac(terms(a[1]), terms(b[1])) * 0.6


def test_novelty_check_of_whole_texts(spark, alike):
    folder, rows = alike
    got = {r.pos: r.similarity_score for r in entry.queries()["novelty_check"](spark, folder).collect()}
    for row in rows[1::2]:
        assert got[row[0]] == pytest.approx(max(similar(row, other) for other in rows[::2]), abs=1e-6)
    assert {r >= 0.7 for r in got.values()} == {True, False}


def test_greedy_dedup_of_whole_texts(spark, alike):
    folder, rows = alike
    kept, want = [], {}
    for row in rows:
        best = max((similar(row, other) for other in kept), default=0)
        want[row[0]] = best >= 0.85
        if best < 0.85:
            kept.append(row)
    got = {r.item_id: r.is_duplicate for r in entry.queries()["greedy_dedup"](spark, folder).collect()}
    assert got == want and set(want.values()) == {True, False}


def test_soft_novelty_of_whole_texts(spark, alike):
    folder, rows = alike
    got = {r.item_id: r.similar_item_id for r in entry.queries()["soft_novelty"](spark, folder).collect()}
    words = [set(f"{r[1]} {r[2]}".lower().split()) for r in rows]
    want = {n: next((m for m in range(n) if jac(words[m], words[n]) > 0.6), None) for n in range(len(rows))}
    assert got == want and None in want.values()


# --- every document, however few its sentences -----------------------------------------------------


@pytest.fixture(scope="module")
def short(spark, tmp_path_factory):
    long = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", " ", "One sentence only", long + ".", "Stem is an? Answer here. Wrong one. Wrong two. Other. " + long + ".", "What is a! Answer.", "Never first priority. Always also correct."]
    folder = str(tmp_path_factory.mktemp("short"))
    spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, len(texts)


OF_ITEMS = ("gates_long", "gate_report", "composite_score", "score_again", "improvement_suggestions", "score_reports", "repair_routing", "repairs_applied", "option_rewrites")


@pytest.mark.parametrize("name", [*OF_ITEMS, "quick_ambiguity", "distractor_review"])
def test_gates_and_scores_of_every_document(spark, short, name):
    folder, n = short
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    line = compare(spark, con, folder, name, entry.queries()[name + ""], entry.oracle_sql()[name + ""])
    assert line.endswith("ok"), line
    if name in ("gate_report", "composite_score", "repairs_applied", "quick_ambiguity", "distractor_review"):
        assert entry.queries()[name + ""](spark, folder).count() == n


# --- a key that every row holds -------------------------------------------------------------------------


def test_a_key_of_all_rows_takes_few_rounds(spark, monkeypatch):
    n, stored = 1500, []
    real = novelty.durable
    monkeypatch.setattr(novelty, "durable", lambda df: stored.append(1) or real(df))
    rows = [(i, i, "same tag", f"common unique{i}x") for i in range(n)] + [(n + i, n + i, "same tag", f"common unique{i}x") for i in range(5)]
    items = spark.createDataFrame(rows, "item_id long, pos long, concept_tag string, learning_target string")
    got = novelty.greedy_dedup(items, 0.7, head=16).collect()
    assert {r.pos for r in got if r.is_duplicate} == {n + i for i in range(5)}
    rounds = (len(stored) - 1) / 4
    assert rounds <= 2 * 10.6


def test_greedy_blocks_equal_the_walk(spark):
    rng = random.Random(8)
    rows = [(i, i, rng.choice(["one two", "one", "two"]), " ".join(sorted(rng.sample(["alpha", "gamma", "delta", "omega", "kappa", "sigma"], rng.randint(1, 4))))) for i in range(120)]
    items = spark.createDataFrame(rows, "item_id long, pos long, concept_tag string, learning_target string")
    for threshold in (0.3, 0.6, 0.85):
        kept, want = [], {}
        for i, _, tag, target in rows:
            own = (i, tag.replace(" ", "_"), target.split(), None)
            best = max((all_pairs(own, k) for k in kept), default=0)
            want[i] = best >= threshold
            if not want[i]:
                kept.append(own)
        got = {r.pos: r.is_duplicate for r in novelty.greedy_dedup(items, threshold, head=2).collect()}
        assert got == want


def test_a_repeat_sees_concepts_kept_after_its_first_copy(spark):
    """The second copy of b is nearer to a concept kept between the two copies."""
    targets = ["alpha gamma delta omega kappa", "alpha gamma delta omega sigma", "alpha gamma omega sigma", "alpha gamma delta omega sigma"]
    items = spark.createDataFrame([(i, i, t, x) for i, (t, x) in enumerate(zip("abcb", targets))], "item_id long, pos long, concept_tag string, learning_target string")
    got = {r.pos: (r.is_duplicate, r.duplicate_of, round(r.similarity_score or 0, 6)) for r in novelty.greedy_dedup(items, 0.39).collect()}
    own = [(i, t, x.split(), None) for i, (t, x) in enumerate(zip("abcb", targets))]
    assert all_pairs(own[2], own[0]) < 0.39 and got[2][0] is False
    near = [(all_pairs(own[1], own[k]), own[k][1]) for k in (0, 2)]
    assert got[1] == (True, "a", round(near[0][0], 6)) and got[3] == (True, *reversed([round(max(near)[0], 6), max(near)[1]]))


def test_greedy_rounds_store_no_terms(spark, monkeypatch):
    """Whole sets are written once; rows of the rounds are of fixed width, and a key of one signature is in none."""
    stored, files = [], []
    real, write = novelty.durable, novelty.written
    monkeypatch.setattr(novelty, "durable", lambda df: stored.append(df.columns) or real(df))
    monkeypatch.setattr(novelty, "written", lambda df: files.append(write(df)) or files[-1])
    targets = [f"common shared{i // 2} thing{i // 2} unique{i}x only{i}y" for i in range(20)] + ["lonely words stand apart"]
    items = spark.createDataFrame([(i, i, "tag", t) for i, t in enumerate(targets)], "item_id long, pos long, concept_tag string, learning_target string")
    got = {r.pos: r.is_duplicate for r in novelty.greedy_dedup(items, 0.65, head=4).collect()}
    assert got == {i: i % 2 == 1 and i < 20 for i in range(21)}
    assert not any({"terms", "_words"} & set(columns) for columns in stored)
    assert ["_words" in f.columns for f in files].count(True) == 1
    assert 20 not in {r.sig_id for r in files[1].select("sig_id").collect()}


def test_funnel_is_dealt_by_rows(spark, monkeypatch):
    """More rows are more tasks, each with as many rows at most, and the result stays the same."""
    from catalog import courses

    folder = "/root/testdata/sf0.001"
    want = sorted(map(tuple, courses.funnel_flat(spark, folder).collect()))
    monkeypatch.setattr(courses, "ROWS_OF_TASK", 100)
    parts = courses._parts(spark, folder)
    n = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert n / 100 <= parts["item"] < n / 100 + 1
    assert sorted(map(tuple, courses.funnel_flat(spark, folder).collect())) == want
