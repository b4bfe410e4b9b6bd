"""Near-duplicates, decontamination, packing, token shards, classifier and pipeline."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from catalog.check import compare, connect
from lectern.llm import decontaminate, near_dup, packing, quality_model, queries, token_store, tokens
from lectern.llm.common import table
from lectern.llm.components import components

WORDS = [a + b for a in "ba de fi ko lu me no pa ri su to vi".split() for b in "na re si lo mu ke".split()]
DOCS = "doc_id long, text string, n long, keys string, component_id long"


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def edited(draw, text, share):
    return " ".join(draw.choice(WORDS) if draw.random() < share else w for w in text.split())


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in pairs], DOCS).repartition(3)


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(pairs, size):
    sets = {i: shingle_set(t, size) for i, t in pairs}
    root = {i: i for i, _ in pairs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    draw = random.Random(size)
    texts = [None, "", " \n", "one", "ONE", "one two", "One  two", "a b c d e f", "a b c d e f"]
    for n in (8, 30, 120, 400):
        base = prose(draw, n)
        texts += [base, base, base.upper()] + [edited(draw, base, s) for s in (0.01, 0.02, 0.04, 0.06, 0.1, 0.2) for _ in range(4)]
    passage = prose(draw, 60)
    texts += [passage + " " + prose(draw, n) for n in (5, 10, 12, 15, 18, 30, 60) for _ in range(3)]
    chain = prose(draw, 200).split()
    texts += [" ".join(chain[i:i + 160]) for i in range(0, 40, 8)]  # each is linked with its neighbour only
    pairs = list(enumerate(texts))
    draw.shuffle(pairs)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(frame(spark, pairs), size=size).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(pairs, size)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_nulls_repeats_long_and_empty(spark):
    long = prose(random.Random(1), 60_000)
    docs = frame(spark, [(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b"), (2, "a b"), (3, long), (4, long + " end")])
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 3, True), ("4", 3, False), ("None", None, True), ("None", None, True)]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (50, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 50, 101: 50, 102: 50}
    assert components(links.limit(0)).count() == 0


def test_min_max_halves_agree_with_similarity():
    draw = np.random.default_rng(3)
    common, a, b = (draw.integers(-(1 << 62), 1 << 62, n) for n in (800, 100, 100))
    sets = [np.concatenate([common, a]), np.concatenate([common, b])]
    keys = near_dup.min_max_keys(np.concatenate(sets), np.array([0, 900]), bands=4000, rows=1)
    for half in (slice(0, 2000), slice(2000, 4000)):
        assert abs(np.mean(keys[0, half] == keys[1, half]) - 0.8) < 0.04


def test_decontamination_finds_planted_overlaps(spark):
    draw = random.Random(9)
    bench = [prose(draw, 30) for _ in range(5)] + [prose(draw, 7), "too short here", None, "", prose(draw, 12)]
    w = bench[0].split()
    changed = " ".join(["zzz" if i in (6, 19) else x for i, x in enumerate(w)])
    texts = [
        (0, prose(draw, 50) + " " + bench[0] + " " + prose(draw, 50)), (1, changed), (2, f"x {bench[1].upper()}! {bench[2]}"), (3, prose(draw, 3000)),
        (4, " ".join(w[4:16])), (5, " ".join(w[4:15])), (6, " ".join([*w[4:9], "zzz", *w[10:16]])), (7, bench[5]), (8, "too short here"), (9, None), (10, ""), (None, bench[0]),
        (11, prose(draw, 20_000) + " " + bench[3]), (11, prose(draw, 20_000) + " " + bench[3]), (12, ", ".join(bench[9].split())), (13, " ".join("zzz" if i % 4 == 0 else x for i, x in enumerate(w)))]
    items = spark.createDataFrame([(i, t, "c") for i, t in enumerate(bench)] + [(None, bench[0], "c"), (3, bench[3], "c")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["first_token"], r["n_tokens"]) for r in decontaminate.overlaps(frame(spark, texts), items).collect()}
    assert got == {
        (0, 0): (30, 50, 30), (1, 0): (24, 0, 30), (2, 1): (30, 1, 30), (2, 2): (30, 31, 30), (4, 0): (12, 0, 12), (6, 0): (9, 0, 12), (7, 5): (7, 0, 7),
        (11, 3): (30, 20_000, 30), (12, 9): (12, 0, 12)}
    clean = decontaminate.clean(frame(spark, texts), items)
    assert clean.columns == ["doc_id", "text", "n", "keys", "component_id"]
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(["3", "5", "8", "9", "10", "13"])  # the null id holds a whole item
    assert decontaminate.overlaps(frame(spark, texts), items.limit(0)).count() == 0 and decontaminate.overlaps(frame(spark, texts).limit(0), items).count() == 0


ODD = [None, "", " ", "plain text", "Plain  text\n\nwith   gaps ", "naïve café – “quotes” 東京 émoji 😀", "a<|endoftext|>b <|endoftext|> c", "x" * 5000, "l'été d'où it's we'll\tTab\r\nline", "\x85 a\xa0b \x1c c", "ǅ İ ß ẞ é 1234567 ½²", " 's 're don't"]


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_library(name, drops):
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokens.vocabulary(name)), tokens.Encoder(tokens.vocabulary(name), drops)
    draw = random.Random(2)
    made = ["".join(draw.choice(["ab", " ", "  ", "\n", "é", "'s", "1", ".", "-", "Z", "\t", "ÿ", "ı"]) for _ in range(draw.randrange(40))) for _ in range(400)]
    for text in [*ODD, *made]:
        want = plain.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want, repr(text)


def ids_of(text, name, end):
    from tokenizers import Tokenizer

    return np.asarray([*Tokenizer.from_file(tokens.vocabulary(name)).encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


def test_packing_is_a_gapless_round_trip_with_little_padding(spark, sf):
    path = tokens.vocabulary("word_bpe_49k.json")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, "word " * 30_000)], "doc_id long, text string")
    got = packing.pack(docs.union(extra), path, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    ends = got["offset"] + got["length"]
    assert (ends.groupby(got["sequence_id"]).shift(1).fillna(0) == got["offset"]).all() and ends.max() <= 2048
    assert (got["ids_crc32"] == got["ids"].map(lambda b: zlib.crc32(bytes(b)))).all()
    n = got["sequence_id"].nunique()
    assert set(got["sequence_id"]) == set(range(n)) and got["length"].sum() > 0.975 * 2048 * n
    joined = got.sort_values(["doc_id", "start"]).groupby("doc_id")["ids"].agg(lambda x: b"".join(map(bytes, x)))
    for r in docs.union(extra).collect():
        assert joined[r["doc_id"]] == ids_of(r["text"], "word_bpe_49k.json", 1)
    repeated = packing.pack(extra.union(extra).limit(0), path)
    assert repeated.count() == 0
    twice = packing.pack(spark.createDataFrame([(None, "a b")] * 3, "doc_id long, text string"), path)
    assert twice.count() == 3 and twice.select("sequence_id", "offset").distinct().count() == 3


def test_plan_places_every_piece_once():
    draw = np.random.default_rng(4)
    for counts in ({}, {256: 3}, {1: 1000}, {200: 5, 56: 2, 30: 7}, {c: int(n) for c, n in enumerate(draw.integers(0, 500, 257)) if c}):
        made = packing.plan(counts, 256)
        used = {}
        for classes, times in made:
            assert sum(classes) <= 256 and times > 0
            for c in classes:
                used[c] = used.get(c, 0) + times
        assert used == {c: n for c, n in counts.items() if n}


def test_nnls_meets_its_conditions():
    draw = np.random.default_rng(5)
    a, b = draw.random((12, 30)), draw.random(12) * 10
    x = packing.non_negative_least_squares(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and gain.max() < 1e-4 and np.abs(gain[x > 0]).max() < 1e-4
    assert packing.combinations(6) == [(6,), (5, 1), (4, 2), (4, 1, 1), (3, 3), (3, 2, 1), (2, 2, 2)]


def test_token_shards_round_trip(spark, sf, tmp_path):
    path = tokens.vocabulary("byte_bpe_50k.json")
    docs = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")).repartition(4)
    manifest = token_store.write_shards(docs, f"file://{tmp_path}/shards", path)
    got = {r["doc_id"]: r for r in token_store.read_documents(manifest, with_ids=True).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        want, row = ids_of(r["text"], "byte_bpe_50k.json", 2), got[r["doc_id"]]
        assert (row["start"], row["n_tokens"], row["ids_crc32"], bytes(row["ids"])) == (start, len(want) // 4, zlib.crc32(want), want)
        start += len(want) // 4
    assert token_store.read_documents(token_store.write_shards(docs.limit(0), f"file://{tmp_path}/none", path)).count() == 0
    one = manifest.orderBy("shard").first()
    shard = token_store.Shard(one["path"])
    ids = np.frombuffer(b"".join(b for _, b in shard.documents()), "<u4")
    token = int(ids[len(ids) // 2])
    assert [shard.access(i) for i in (0, 7, len(ids) - 1)] == [ids[0], ids[7], ids[-1]]
    assert shard.count(token) == int((ids == token).sum()) and list(shard.occurrences(token))[:20] == np.flatnonzero(ids == token)[:20].tolist()


def test_wavelet_matrix_and_segments(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT", 1000)
    draw = np.random.default_rng(6)
    for high in (1, 2, 300, 70_000):
        ids = draw.integers(0, high, 3000).astype("<u4")
        w = token_store.WaveletMatrix.of(ids)
        assert (w.tokens() == ids).all() and all(w.access(i) == ids[i] for i in range(0, 3000, 97))
        for token in {int(ids[0]), int(ids[1500]), high - 1, high + 5, 1 << 20}:
            at = np.flatnonzero(ids == token)
            assert w.count(token) == len(at) and w.count(token, 100, 2000) == ((at >= 100) & (at < 2000)).sum()
            assert [w.select(token, k) for k in range(0, len(at), 11)] == at[::11].tolist()
        place = str(tmp_path / f"{high}.wm")
        with open(place, "wb") as f:
            writer = token_store.ShardWriter(f)
            for key, part in enumerate(np.array_split(ids, [0, 10, 2500])):
                writer.add(key, part.tobytes())
            writer.close()
        shard = token_store.Shard(place)
        assert b"".join(b for _, b in shard.documents()) == ids.tobytes() and len(shard.segments) > 2
        assert shard.count(int(ids[3])) == (ids == ids[3]).sum() and list(shard.occurrences(int(ids[3])))[:50] == np.flatnonzero(ids == ids[3])[:50].tolist()


def test_classifier_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = quality_model.classify(docs, labels, rows=2000).join(labels, "doc_id").filter("held_out").toPandas()
    order = got["score"].rank()
    n1, n0 = (got["quality"] == 1).sum(), (got["quality"] == 0).sum()
    auc = (order[got["quality"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert len(got) > 200 and auc > 0.98 and (got["predicted"] == got["quality"]).mean() > 0.96


def test_classifier_edges(spark):
    docs = frame(spark, [(i, t) for i, t in enumerate([None, "", "x" * 200_000, "good text", "bad bad bad bad"])] + [(None, "good text"), (3, "good text")])
    labels = spark.createDataFrame([(i, i % 2, "c") for i in range(5)] + [(None, 1, "c"), (2, None, "c"), (3, 7, "c")], "doc_id long, quality int, text string")
    rows = quality_model.classify(docs, labels).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    assert [r["held_out"] for r in rows if r["doc_id"] == 4] == [zlib.crc32(b"4") % 5 == 0]
    assert quality_model.classify(docs, labels.limit(0)).first()["score"] == 0.5 and quality_model.classify(docs.limit(0), labels).count() == 0


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf).cache()
        assert after.columns == docs.columns and 0 < after.count() <= kept.count(), name
        kept = after
    larger = "/root/testdata/sf0.1"
    bad = {r[0] for r in table(spark, larger, "labels").filter("quality = 0").select("doc_id").collect()}
    good = {r[0] for r in table(spark, larger, "labels").filter("quality = 1").select("doc_id").collect()}
    first = {r[0] for r in corpus_pipeline.keep_good(spark, table(spark, larger, "documents"), larger).select("doc_id").collect()}
    assert len(bad & first) <= 0.05 * len(bad) and len(good - first) <= 0.01 * len(good)
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert not any(re.search(r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+", t or "") for _, t in texts)
    again = near_dup.near_duplicates(kept.select("doc_id", "text"))
    assert again.filter("NOT kept").count() <= 1  # redaction may bring two texts closer
    packed = corpus_pipeline.run(spark, sf)
    assert {r[0] for r in packed.select("doc_id").collect()} == {i for i, _ in texts}


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_query_matches_sql(spark, sf, name):
    query, sql = queries.QUERIES[name]
    line = compare(spark, connect(sf), sf, name, query, sql)
    assert line.endswith("ok"), line


def test_packing_holds_little_at_once(spark):
    """The library encodes few texts at once and a batch for Python is short; ids stay the same."""
    path, given, calls = tokens.vocabulary("word_bpe_49k.json"), [f"日本 text {i} " * 400 for i in range(60)], []
    encoder = tokens.Encoder(path, drops_space=True)
    real = encoder.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, add_special_tokens):
            calls.append(sum(map(len, texts)))
            return real.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = Counted()
    got = encoder.encode_all(given)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [real.encode(t, add_special_tokens=False).ids for t in given]
    assert max(calls) <= tokens.WHOLE_CHARS + len(given[-1])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []
    stored = packing.stored
    try:
        packing.stored = lambda df: (seen.append(spark.conf.get(name)), stored(df))[1]
        assert packing.pack(spark.range(2500).selectExpr("id AS doc_id", "'a b' AS text"), path).count() == 2500
    finally:
        packing.stored = stored
    assert seen == ["1000"] and spark.conf.get(name) == before
