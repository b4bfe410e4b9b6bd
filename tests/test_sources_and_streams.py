import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import corrections, images, metrics
from lectern.plans import flows, presets
from lectern.sources import readers, store
from lectern.streaming import jobs, state


@pytest.fixture()
def books(tmp_path):
    def put(path, text):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")

    put(tmp_path / "in/plain/one/one.md", "# A\nalpha text\n![x](images/a.png)\n# B\nbeta text")
    put(tmp_path / "in/plain/one/one_content_list.json", json.dumps([{"text": "A", "page_idx": 1}, None, "s", 3, {"text": "B", "page_idx": 2}, {"text": "more"}]))
    put(tmp_path / "in/plain/one/other_content_list.json", "[]")
    put(tmp_path / "in/shared set/two/two.md", "# C\ngamma text")
    return tmp_path


def test_embed_books(spark, books):
    root, out = str(books / "in"), str(books / "store")
    mapping = spark.createDataFrame([("shared set", ["s1", "s2"])], "folder string, collections array<string>")
    plan = flows.embed_books(spark, root, out, lambda df: df, mapping, dry_run=True)
    assert sorted((r.collection, r.title) for r in plan.collect()) == [("plain", "one"), ("s1", "two"), ("s2", "two")]
    flows.embed_books(spark, root, out, lambda df: df, mapping)
    flows.embed_books(spark, root, out, lambda df: df, mapping)  # a second run replaces, it does not add
    rows = store.collections(spark, out).orderBy("collection", "chunk_id").collect()
    assert [(r.collection, r.chunk_id, r.section_heading, r.page_numbers, r.image_paths) for r in rows] == [
        ("plain", "chunk_0", "A", [1], ["images/a.png"]), ("plain", "chunk_1", "B", [2], []), ("s1", "chunk_0", "C", [], []), ("s2", "chunk_0", "C", [], []),
    ]


def test_pdf_inventory(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"%PDF-" + b"x" * 10_001)
    (tmp_path / "small.pdf").write_bytes(b"%PDF-x")
    (tmp_path / "wrong.pdf").write_bytes(b"x" * 20_000)
    got = {r.title: r.is_valid for r in readers.pdf_files(spark, str(tmp_path)).collect()}
    assert got == {"good": True, "small": False, "wrong": False}


def course():
    item = {"item_id": "item_01", "item_type": "MCQ", "title": "t", "learning_target": "lt", "content": "A question long enough", "options": ["a", "b", "c", "d"],
            "correct_answer_index": 1, "explanation": "An explanation that is long enough", "source_reference": {"summary": "s", "chunk_ids": ["c1"]}}
    bad = dict(item, item_id="item_02", options=["a", "A", "c"], correct_answer_index=7)
    capsule = {"capsule_id": "cap_01", "title": "c", "learning_goal": "A goal long enough", "capsule_type": "Practice", "items": [item, bad]}
    lab = {"lab_id": "lab_01", "title": "l", "objective": "An objective", "lab_type": "odd", "capsules": [capsule]}
    sub = {"name": "Sub One", "description": "long enough text", "labs": [lab]}
    topic = {"name": "Topic One", "learning_objectives": [{"objective": "o"}], "subtopics": [sub, {"name": "Empty", "description": "long enough text", "labs": []}]}
    module = {"domain_name": "Domain One", "domain_weight_pct": 100, "overview": "long enough text", "topics": [topic]}
    return {"certification_name": "Cert/One A", "overview": {}, "version": 1, "domain_modules": [module]}


def test_validate_and_correct(spark, tmp_path):
    (tmp_path / "cert.json").write_text(json.dumps(course()))
    courses = readers.courses(spark, str(tmp_path / "*.json"))
    reply = json.dumps({"stem": "A new question text", "options": ["1", "2", "3", "4"], "correct_index": 0})
    first = flows.validate_and_correct(courses, None)
    status = {("/".join(r.entity_path) or "-"): r.overall_status for r in first["results"].collect()}
    path = "domain_one/topic_one/sub_one/lab_01"
    assert status == {
        "-": "passed", "domain_one": "passed", "domain_one/topic_one": "passed", "domain_one/topic_one/sub_one": "passed", "domain_one/topic_one/empty": "critical",
        path: "minor", f"{path}/cap_01": "passed", f"{path}/cap_01/item_01": "passed", f"{path}/cap_01/item_02": "critical",
    }
    queue = first["queue"].collect()
    kinds = {(r.rule_name, r.action_type, r.priority) for r in queue}
    assert kinds == {
        ("subtopic_has_labs", "manual_review", 100), ("correct_index_valid", "manual_review", 100), ("options_count_valid", "regenerate", 50),
        ("no_duplicate_options", "regenerate", 50), ("lab_type_valid", "auto_fix", 10),
    }
    assert [r.priority for r in queue] == sorted((r.priority for r in queue), reverse=True)
    ids = [r.action_id for r in queue if r.action_type == "regenerate"]
    replies = spark.createDataFrame([(i, 1, '{"bad') for i in ids] + [(i, 2, reply) for i in ids], "action_id string, attempt int, reply string")
    second = flows.validate_and_correct(courses, replies)
    fixed = {r.item_id: (r.content, r.correct_answer_index, r.explanation) for r in second["items"].collect()}
    assert fixed["item_02"] == ("A new question text", 0, "An explanation that is long enough")
    assert fixed["item_01"][0] == "A question long enough"
    row = second["status"].first()
    fresh = second["courses"].first()
    lab = fresh.domain_modules[0].topics[0].subtopics[0].labs[0]
    assert (fresh.version, fresh.validation_status, lab.lab_type) == (2, "needs_review", "odd")  # its issue names the field "lab", which labs lack
    assert [(i.item_id, i.content, i.correct_answer_index) for i in lab.capsules[0].items] == [("item_01", "A question long enough", 1), ("item_02", "A new question text", 0)]
    assert (row.corrections_applied, row.corrections_failed, row.manual_reviews, row.validation_status, row.output_version) == (2, 1, 2, "needs_review", 2)


def test_queue_round_trip(spark, tmp_path):
    rows = [("Cert A", f"action_{i}", "item", f"e{i}", ["m", f"e{i}"], "regenerate", {"f": "v"}, None, p, "pending", None, None, None) for i, p in enumerate([10, 100, 50])]
    schema = "certification_name string, action_id string, entity_type string, entity_id string, entity_path array<string>, action_type string, field_corrections map<string,string>, regenerate_prompt string, priority int, status string, created_at timestamp, applied_at timestamp, error string"
    actions = spark.createDataFrame(rows, schema)
    headers = spark.createDataFrame([("Cert A", 1, 2)], "certification_name string, source_version int, target_version int").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    path = str(tmp_path / "queue")
    store.write_queue(actions, headers, path)
    store.append_actions(actions.limit(1).withColumn("action_id", F.lit("extra")), path)
    back = readers.queue(spark, path + "/*").collect()
    assert sorted(r.action_id for r in back) == ["action_0", "action_1", "action_2", "extra"]
    assert {(r.source_version, r.target_version) for r in back} == {(1, 2)}
    counts = corrections.queue_counts(actions, ["certification_name"]).first()
    assert (counts.regenerate, counts.pending_count) == (3, 3)
    lone = tmp_path / "lone"
    lone.mkdir()
    (lone / "x.txt").write_text('{"action_id": "a"}\n')
    with pytest.raises(Exception, match="no queue header"):
        readers.queue(spark, str(lone)).collect()


def test_two_queues_do_not_touch_each_other(spark, tmp_path):
    def write(name, n):
        rows = [(name, f"{name}_{i}", "item", f"e{i}", ["m"], "regenerate", {"f": "v"}, None, i % 3, "pending") for i in range(n)]
        actions = spark.createDataFrame(rows, "certification_name string, action_id string, entity_type string, entity_id string, entity_path array<string>, action_type string, field_corrections map<string,string>, regenerate_prompt string, priority int, status string")
        headers = spark.createDataFrame([(name, n, n + 1)], "certification_name string, source_version int, target_version int").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
        store.write_queue(actions, headers, str(tmp_path / "q"))

    write("A", 5)
    write("B", 4)
    write("A", 3)
    back = readers.queue(spark, str(tmp_path / "q/*")).collect()
    assert sorted(r.action_id for r in back) == ["A_0", "A_1", "A_2", "B_0", "B_1", "B_2", "B_3"]
    assert {(r.certification_name, r.source_version) for r in back} == {("A", 3), ("B", 4)}
    lines = [x for f in sorted((tmp_path / "q/certification=B").glob("part*")) for x in f.read_text().splitlines()]
    assert "queue_header" in lines[0] and [json.loads(x)["priority"] for x in lines[1:]] == [2, 1, 0, 0]


def test_two_queue_files_in_one_folder_keep_their_headers(spark, tmp_path):
    for name in ("x", "y"):
        head = {"_type": "queue_header", "certification_name": name, "source_version": 1, "target_version": 2}
        (tmp_path / f"{name}.jsonl").write_text(json.dumps(head) + "\n" + json.dumps({"action_id": name}) + "\n")
    assert {(r.action_id, r.certification_name) for r in readers.queue(spark, str(tmp_path)).collect()} == {("x", "x"), ("y", "y")}


def test_collections_fold_repeats_and_planned_ones_go(spark, tmp_path):
    path = str(tmp_path / "c")
    make = lambda rows: spark.createDataFrame(rows, "collection string, chunk_id string, text string")
    store.upsert_collections(make([("a", "1", "x"), ("a", "1", "w"), ("b", "1", "y")]), path)
    assert sorted((r.collection, r.text) for r in store.collections(spark, path).collect()) == [("a", "w"), ("b", "y")]
    store.rebuild_collections(make([("a", "2", "z")]), path, spark.createDataFrame([("a",), ("b",)], "collection string"))
    assert [(r.collection, r.chunk_id) for r in store.collections(spark, path).collect()] == [("a", "2")]
    assert sorted(r.text for r in store.collections(spark, path, 1).collect()) == ["w", "y"]


def test_queue_keeps_document_order(spark, tmp_path):
    doc = course()
    capsule = doc["domain_modules"][0]["topics"][0]["subtopics"][0]["labs"][0]["capsules"][0]
    capsule["items"] = [dict(capsule["items"][1], item_id=f"item_{i}") for i in range(1, 12)]
    (tmp_path / "cert.json").write_text(json.dumps(doc))
    queue = flows.validate_and_correct(readers.courses(spark, str(tmp_path / "*.json")), None)["queue"].collect()
    assert [r.entity_id for r in queue if r.rule_name == "options_count_valid"] == [f"item_{i}" for i in range(1, 12)]


def test_snapshots_and_versions(spark, tmp_path):
    df = spark.createDataFrame([("c1", "Cert (A)", 1), ("c1", "Cert (A)", 2)], "course_id string, certification_name string, version int")
    path = str(tmp_path / "snap")
    store.save_snapshot(df.filter("version = 1"), "labs", path, engine="e")
    store.save_snapshot(df.filter("version = 2"), "items", path)
    assert {(r.certification, r.snapshot_version, r.stage) for r in store.snapshots(spark, path).collect()} == {("Cert_A", 1, "labs"), ("Cert_A", 2, "items")}
    with pytest.raises(ValueError):
        store.save_snapshot(df, "nothing", path)
    store.write_version(df, str(tmp_path / "v"))
    assert [r.version for r in store.latest(spark, str(tmp_path / "v")).collect()] == [2]
    assert store.stages_between("course", "items") == ["labs", "capsules", "items"]
    assert presets.preset("strict").use_ambiguity_gate and not presets.preset("fast").use_novelty_gate


def test_image_descriptions(spark):
    notes = spark.createDataFrame([(0, "images/a.png", "first"), (1, "b.png", "second"), (2, "old/c.png", "third")], "annotation_pos int, path string, description string")
    shown = spark.createDataFrame([("images/a.png",), ("images/b.png",), ("x/c.png",), ("d.png",)], "path string")
    got = {r.path: r.description for r in images.describe_images(shown, notes).collect()}
    assert got == {"images/a.png": "first", "images/b.png": "second", "x/c.png": "third", "d.png": "No description"}


def test_empty_metrics(spark):
    row = metrics.quality_metrics(spark.createDataFrame([], metrics.RECORD)).first()
    assert (row.total_items, row.evidence_coverage_ratio) == (0, 0.0)


# --- streams: the same rows in batch and in stream give the same result ------------------------------------


def stream_of(spark, df, path, files=3):
    df.repartition(files).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, mode, name, tmp_path):
    q = (
        df.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    )
    assert q.awaitTermination(60), "stream did not end"
    return df.sparkSession.table(name)


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("learner_id"), (F.col("event_id") % 3).alias("item_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("is_correct"), (F.col("event_id") % 5 + 1).alias("confidence"), F.col("value").alias("seconds"),
    )


def test_mastery_stream_equals_batch(spark, sf, tmp_path):
    from lectern.operators.learner import mastery

    rows = events(spark, sf).filter("learner_id < 6")
    ordered = rows.repartitionByRange(3, "ts")
    path = str(tmp_path / "m")
    ordered.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)  # one batch: file order is not time order
    got = drain(state.mastery_state(stream), "update", "mastery_rows", tmp_path)
    want = mastery(rows).select("learner_id", "item_id", "reviews", "streak", "is_mastered")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_novelty_registry_stream(spark, tmp_path):
    from lectern.operators.novelty import greedy_dedup
    from tests.test_operators import concept_rows

    rows = [("cap", *r) for r in concept_rows(9, 30)]
    df = spark.createDataFrame(rows, "capsule_id string, pos int, item_id string, concept_tag string, learning_target string")
    path = str(tmp_path / "n")
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    got = {r.item_id: not r.is_novel for r in drain(state.novelty_registry(stream), "append", "novelty_rows", tmp_path).collect()}
    assert got == {r.item_id: r.is_duplicate for r in greedy_dedup(df, scope=["capsule_id"]).collect()}


def test_window_and_metric_streams(spark, sf, tmp_path):
    rows = events(spark, sf)
    scores = rows.select("ts", F.col("seconds").alias("score"))
    got = drain(jobs.pass_rates(stream_of(spark, scores, str(tmp_path / "p")), "1 day"), "complete", "rates", tmp_path)
    want = jobs.pass_rates(scores, "1 day")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sessions = drain(jobs.sessions_stream(stream_of(spark, rows, str(tmp_path / "s"), 1), "1 hour"), "append", "sessions", tmp_path)
    assert sessions.count() > 0 and sessions.filter("correct > items").count() == 0
    quotes = rows.select("item_id", "ts", F.when(F.col("confidence") > 2, " Same Text").otherwise("same text").alias("sentence"))
    once = drain(jobs.dedup_quotes_stream(stream_of(spark, quotes, str(tmp_path / "q"), 1), "60 days"), "append", "quotes_once", tmp_path)
    assert once.count() == 3
    record = spark.createDataFrame([("i", "c", True, 1, 2, 1, False, True, True, False, None, True, False, False, "easy", "ok")], metrics.RECORD)
    counts = drain(jobs.rolling_metrics(stream_of(spark, record, str(tmp_path / "r"), 1)), "update", "metric_rows", tmp_path).first()
    assert (counts.total_items, counts.items_duplicate) == (1, 1)


def test_collection_stream(spark, tmp_path):
    book = spark.createDataFrame([("b1", "col", "# A\ntext one\n# B\ntext two", [("A", 1), ("B", 2)], "T", "U", "f1")], jobs.BOOK_ROWS)
    book.write.json(str(tmp_path / "in"))
    for _ in range(2):  # a replay writes the same rows
        jobs.load_collections(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / f"ck{_}")).awaitTermination(60)
    rows = store.collections(spark, str(tmp_path / "out")).collect()
    assert sorted((r.collection, r.section_heading, tuple(r.page_numbers)) for r in rows) == [("col", "A", (1,)), ("col", "B", (2,))]
