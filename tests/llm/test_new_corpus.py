"""Spelling variants, whitening and packing into the fewest sequences."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat_tools, decontaminate, fewest_bins, near_dup, quality_model, spelling, token_store, tokens
from lectern.llm.common import table

DOCS = "doc_id long, text string, n long, word string, length long, near string"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in pairs], DOCS).repartition(3)


# --- spelling ---------------------------------------------------------------------------------------


def brute_variants(pairs, one_in, least, times):
    n = Counter()
    for i, text in pairs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % one_in == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out = {}
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form = best if best and n[best] >= times * n[w] else None
        out[w] = [form, n[w], len(found), n[form] if form else None]

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (f, root(w), k, m, fn) for w, (f, k, m, fn) in out.items()}


@pytest.mark.parametrize("one_in", [3, 199])
def test_variants_equal_brute_force(spark, one_in):
    draw = random.Random(one_in)
    base = ["abcdef", "Señora", "straße", "xxxxxx", "xxxxxxx", "bananas", "ananasb", "ÀÉàéññ", "zzyzxqj"]
    made = set(base)
    for w in base:
        for _ in range(14):
            i, c = draw.randrange(len(w)), draw.choice("abéñxzABZ")
            made.add(draw.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:], "".join(draw.sample(w, len(w)))]))
    chain = ["kkkkkk", "kkkkkl", "kkkkll", "kkklll"]
    words = [w for w in sorted(made) for _ in range(draw.choice([1, 2, 3, 12]))] + [w for k, w in enumerate(chain) for _ in range(2 * 6 ** k)]
    draw.shuffle(words)
    pairs = [(i // 3, draw.choice([" ", "-", "1", "ŝ", "\n"]).join(words[k:k + 40])) for i, k in enumerate(range(0, len(words), 40))]
    pairs += [(None, "abcdef Abcdef"), (7, None), (8, ""), (9, "short"), (10, "x" * 5000), (10, "x" * 5000), (10, "y" * 3000 + "z")]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame(spark, pairs), one_in=one_in, least=2).collect()}
    want = brute_variants(pairs, one_in, 2, 5)
    assert got == want
    assert any(v[0] for v in want.values()) and (one_in == 3 or want["kkkkkk"][1] == "kkklll")
    assert spelling.variants(frame(spark, pairs).limit(0)).count() == 0


def test_near_vectors_share_a_signature(spark):
    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzéñß"
    rows = []
    for _ in range(300):
        w = [draw.choice(letters) for _ in range(draw.randrange(6, 14))]
        v = list(w)
        at = draw.randrange(len(v))
        v[at:at + 1] = draw.choice([[], [draw.choice(letters)], [v[at], draw.choice(letters)]])
        rows.append(("".join(sorted(w)), "".join(sorted(v))))
    got = spark.createDataFrame(rows, "a string, b string").select(
        F.arrays_overlap(spelling.signatures(F.col("a")), spelling.signatures(F.col("b"))).alias("met"), F.size(spelling.signatures(F.col("a"))).alias("n")).collect()
    assert all(r.met and r.n == 28 for r in got)
    assert sorted("".join(spelling.parts(8))) == sorted(spelling.BY_FREQUENCY)


# --- fewest sequences -------------------------------------------------------------------------------


def fewest(sizes, window):
    """Branch and bound over all packings."""
    sizes, best, rooms = sorted(sizes, reverse=True), len(sizes), []

    def go(i):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= sizes[i]:
                k = rooms.index(room)
                rooms[k] -= sizes[i]
                go(i + 1)
                rooms[k] += sizes[i]
        rooms.append(window - sizes[i])
        go(i + 1)
        rooms.pop()

    go(0)
    return best


def test_reduction_keeps_the_optimum():
    draw, reduced, wasted = random.Random(1), 0, 0
    for round_ in range(1500):
        window = draw.choice([10, 12, 20, 30])
        least = max(1, window // draw.choice([3, 4, 5, window]))
        pool = [draw.randint(least, window) for _ in range(draw.randint(1, 9))]
        sizes = pool if round_ % 3 else [draw.choice(pool[:3]) for _ in range(9)]  # with ties
        counts = Counter(sizes)
        fixed, left = fewest_bins.reduce(counts, window)
        used = Counter(left)
        for contents, times in fixed:
            assert sum(a * k for a, k in contents) <= window and sum(k for _, k in contents) <= 3
            for a, k in contents:
                used[a] += k * times
        assert used == counts
        want = fewest(sizes, window)
        assert sum(t for _, t in fixed) + fewest(list(Counter(left).elements()), window) == want
        assert fewest_bins.least_bins(counts, window) <= want
        reduced += bool(fixed)
        wasted += sum(t for _, t in fewest_bins.plan(counts, window)) - want
    assert reduced > 1000 and wasted <= 10


def test_best_fit_on_groups_is_best_fit_one_by_one():
    draw = random.Random(2)
    for _ in range(300):
        sizes = [draw.randint(1, 40) for _ in range(draw.randint(0, 60))]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - s)
            else:
                rooms.append(60 - s)
        groups = fewest_bins.best_fit(Counter(sizes), 60)
        assert Counter({r: n for r, n in Counter(rooms).items()}) == sum((Counter({60 - sum(a * k for a, k in c): t}) for c, t in groups), Counter())


def test_the_plan_depends_on_lengths_only():
    draw = np.random.default_rng(3)
    counts = {s: int(draw.integers(1, 10**9)) for s in range(1, 2049)}
    made = fewest_bins.plan(counts)
    assert len(made) < 4 * 2048 and sum(t for _, t in made) < 1.005 * fewest_bins.least_bins(counts)
    assert fewest_bins.plan({}) == [] and fewest_bins.least_bins({}) == 0


ODD = [None, "", " ", "plain text", "naïve café – 東京 😀", "a<|endoftext|>b", "x" * 5000, "word " * 30_000, "a b", "a b"]


def test_fewest_sequences_round_trip(spark, sf):
    from tokenizers import Tokenizer

    path = tokens.vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    extra = frame(spark, [(10_000 + i, t) for i, t in enumerate(ODD)]).select("doc_id", "text")
    both = docs.union(extra)
    got = fewest_bins.pack(both, path, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    ends = got["offset"] + got["length"]
    assert (ends.groupby(got["sequence_id"]).shift(1).fillna(0) == got["offset"]).all() and ends.max() <= 2048
    assert (got["ids_crc32"] == got["ids"].map(lambda b: zlib.crc32(bytes(b)))).all()
    assert got["sequence_id"].nunique() == fewest_bins.least_bins(Counter(got["length"].tolist()))
    for key, mine in got.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        assert mine["piece"].tolist() == list(range(len(mine))) and mine["start"].tolist() == [2048 * k for k in range(len(mine))]
        assert (mine["length"].iloc[:-1] == 2048).all()
    joined = got.sort_values(["doc_id", "piece"]).groupby("doc_id")["ids"].agg(lambda x: b"".join(map(bytes, x)))
    for r in both.collect():
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids
        assert joined[r["doc_id"]] == np.asarray([*ids, 0], "<u4").tobytes()


def test_fewest_sequences_of_nulls_repeats_and_nothing(spark):
    path = tokens.vocabulary("word_bpe_49k.json")
    got = fewest_bins.pack(frame(spark, [(None, "a b"), (None, None), (3, "a b"), (3, "a b")]), path).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("3", 3), ("3", 3), ("None", 1), ("None", 3)]
    assert {r.sequence_id for r in got} == {0} and sorted(r.offset for r in got)[0] == 0
    assert fewest_bins.pack(frame(spark, [(1, "a")]).limit(0), path).count() == 0


# --- whitening --------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x string, w double"


def brute_whitening(rows, wanted=8):
    """By numpy's own eigenvectors."""
    x = np.array([np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64) + 100_000 for v in rows])
    n, s = len(x), x.sum(0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    return n, ((n * x - s) ** 2).sum(1), centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def same_as_brute(got, ids, rows):
    n, deviation, whitened, explained = brute_whitening(rows)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == len(rows) * whitened.shape[1]
    for c in range(whitened.shape[1]):
        mine = np.array([by[i, c + 1].whitened for i in ids])
        sign = np.sign(mine @ whitened[:, c])
        assert np.abs(mine - sign * whitened[:, c]).max() < 1e-7
        assert all(by[i, c + 1].deviation == k and by[i, c + 1].n == n for i, k in zip(ids, deviation.tolist()))
        assert abs(by[ids[0], c + 1].explained / explained[c] - 1) < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_equals_numpy(spark, sf):
    from lectern.llm import whitening

    rows = table(spark, sf, "embeddings").collect()
    extra = [(10_000, None), (10_001, [float("nan")] * 64), (10_002, [float("inf")] + [0.0] * 63), (10_003, [1.0, 2.0]), (10_004, [None] * 64), (10_005, [])]
    docs = spark.createDataFrame([(r.vec_id, list(r.embedding), 1, "a", 0.0) for r in rows] + [(i, v, 1, "a", 0.0) for i, v in extra], VECTORS).repartition(5)
    same_as_brute(whitening.whiten(docs).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_of_few_dimensions_clusters_and_nothing(spark):
    from lectern.llm import whitening

    draw = np.random.default_rng(2)
    frame_ = lambda rows: spark.createDataFrame([(i, [float(x) for x in v], 1, "a", 0.0) for i, v in rows], VECTORS)
    rows = draw.standard_normal((60, 3)).tolist()
    same_as_brute(whitening.whiten(frame_(list(enumerate(rows)))).collect(), list(range(60)), rows)
    flat = (draw.standard_normal((200, 4)) @ draw.standard_normal((4, 12))).round(1)  # rank 4 but for rounding to whole numbers
    flat[:, 6:] = 0.5
    got = whitening.whiten(frame_(list(enumerate(flat.tolist())))).collect()
    assert max(r.component for r in got) == 6 and got[0].identity_error < 1e-6
    assert whitening.whiten(frame_([(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame_([(1, [1.0, 2.0]), (None, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame_([(1, [1.0])]).limit(0)).count() == 0
    twice = whitening.whiten(frame_([(None, [1.0, 2.0]), (7, [3.0, 2.0]), (7, [3.0, 2.0])])).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in twice) == [("7", 1, 3), ("7", 1, 3), ("None", 1, 3)]
    assert {r.deviation for r in twice if r.vec_id == 7} == {2048 ** 2}


def test_counts_by_inertia_and_feast(spark):
    from lectern.llm import whitening

    draw = np.random.default_rng(3)
    for values in (draw.random(30), np.repeat([3.0, 2.0, 1.0], 8), np.array([5.0, 1.0, 1.0 - 1e-9, 1.0 - 2e-9, 0.5, 0, 0])):
        q, _ = np.linalg.qr(draw.standard_normal((len(values), len(values))))
        a = q * values @ q.T
        a = (a + a.T) / 2
        t = whitening.tridiagonal(a)
        want = np.linalg.eigvalsh(a)
        for shift in (*(want[:-1] + np.diff(want) / 2)[np.diff(want) > 1e-6], -1, 6):
            assert whitening.count_below(t, float(shift)) == (want < shift).sum()
        low, high, inside = whitening.interval(t, 4, 1e-12)
        assert inside >= 4 and inside == (want > low).sum() and want.max() < high
        found, vectors = whitening.feast(spark, a, low, high, inside)
        assert np.abs(found - want[::-1][:inside]).max() < 1e-12 and np.abs(vectors.T @ vectors - np.eye(inside)).max() < 1e-12
        assert np.abs(a @ vectors - vectors * found).max() < 1e-12


# --- rows that repeat an id or have none ---------------------------------------------------------------


def test_a_repeated_id_is_fitted_on_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, label int")
    got = quality_model.fit_rows(docs, labels).collect()
    assert sorted((r.text or "", r.label) for r in got) == [("", 0), ("other", 0), ("other", 1), ("text 0", 1)]


def test_copies_and_leaks_are_decided_by_row(spark):
    draw = random.Random(7)
    one, two, leak = (" ".join(f"w{draw.randrange(10_000)}" for _ in range(40)) for _ in range(3))
    docs = spark.createDataFrame(
        [(1, one, "a"), (2, one, "b"), (2, two, "c"), (7, "same text here of seven words now", "d"), (7, "same text here of seven words now", "d"), (None, leak, "e"), (None, one, "f"), (9, None, "g"), (9, "", "g"), (5, leak + " more", "h"), (5, "clean", "i")],
        "doc_id long, text string, _row string").repartition(3)
    kept = near_dup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r._row) for r in kept.collect()) == sorted([("1", "a"), ("2", "c"), ("7", "d"), ("5", "h"), ("9", "g"), ("9", "g"), ("5", "i")])
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert sorted((str(r.doc_id), r._row) for r in decontaminate.clean(docs, bench).collect()) == sorted([("1", "a"), ("2", "b"), ("2", "c"), ("7", "d"), ("7", "d"), ("None", "f"), ("9", "g"), ("9", "g"), ("5", "i")])
    assert near_dup.drop_copies(docs.limit(0)).count() == 0 and decontaminate.clean(docs.limit(0), bench).count() == 0


# --- tool calls ------------------------------------------------------------------------------------------


def test_long_chains_cycles_and_odd_arguments(spark):
    waits = [("c", 1, str(i), "f", "{}", [str(i - 1)] if i else []) for i in range(1000)]
    waits += [("d", 1, "a", "f", "{}", ["b"]), ("d", 1, "b", "f", "{}", ["a"]), ("d", 1, "after", "f", "{}", ["a"]), ("d", 1, "own", "f", "{}", ["own"]), ("d", 2, "later", "f", "{}", ["a", "gone"])]
    odd = {"deep": "[" * 200_000, "nan": '{"x":NaN}', "inf": '{"x":1e999}', "half": '{"x":"\\ud800"}', "big": '{"n":' + "9" * 400 + "}", "huge": '{"n":' + "9" * 5000 + "}", "true": '{"e":true}', "one": '{"e":1}'}
    waits += [("e", 1, k, "strict", v, None) for k, v in odd.items()] + [("e", 1, f"bad{k}", f"bad{k}", "{}", None) for k in range(3)]
    calls = spark.createDataFrame(waits, "conv_id string, turn long, call_id string, name string, arguments string, waits_for array<string>")
    results = spark.createDataFrame([], "conv_id string, turn long, call_id string, content string")
    rules = [("f", "{}"), ("strict", '{"properties":{"n":{"type":"integer"},"e":{"enum":[1]}}}'), ("bad0", "no json"), ("bad1", "[1]"), ("bad2", '{"required":5}')]
    got = {(r.conv_id, r.call_id): r for r in chat_tools.link(calls, results, spark.createDataFrame(rules, "name string, schema string")).collect()}
    assert all(got["c", str(i)].level == i for i in range(1000))
    assert {k: got["d", k].status for k in ("a", "b", "after", "own", "later")} == {"a": "cycle", "b": "cycle", "after": "cycle", "own": "cycle", "later": "missing"}
    status = {k: r.status for (c, k), r in got.items() if c == "e"}
    assert status == {"deep": "invalid", "nan": "invalid", "inf": "invalid", "half": "no_result", "big": "no_result", "huge": "invalid", "true": "invalid", "one": "no_result", "bad0": "invalid", "bad1": "invalid", "bad2": "invalid"}
    assert "\\ud800" in got["e", "half"].line


# --- token shards ------------------------------------------------------------------------------------------


def test_shards_of_null_and_repeated_ids(spark, tmp_path):
    path = tokens.vocabulary("byte_bpe_50k.json")
    rows = [(None, f"text {i}") for i in range(300)] + [(5, "same")] * 40 + [(5, "other"), (-2, None), (9, "")]
    docs = frame(spark, rows).withColumn("_row", F.lit("clash")).withColumn("start", F.lit(1)).repartition(6)
    manifest = token_store.write_shards(docs.repartition(6), f"file://{tmp_path}/shards", path)
    got = token_store.read_documents(manifest, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 300 + [-2] + [5] * 41 + [9]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    want = Counter((i, np.asarray([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
