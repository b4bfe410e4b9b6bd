"""Work on course documents that is done once: words of a clause, the order of an item's options."""

from pyspark.sql import functions as F

from catalog import courses as K
from lectern.operators import hierarchy as H


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_clause_are_split_once(spark, sf):
    plan = _plan(K.courses(spark, sf).select(F.col("domain_modules")))
    assert plan.count(", (?U)\\s+, ") == 1


def test_options_are_drawn_once(spark):
    rows = [(1, ["a", "b", "c", "d"], 2), (2, ["x"], 0), (3, [], 1), (4, None, 0), (None, ["p", "q"], 5)]
    df = spark.createDataFrame(rows, "id long, options array<string>, answer int")
    out = df.select("id", "options", "answer", H.shuffled_options("options", "answer", "id", "s").alias("m"))
    assert _plan(out.select("m.options", "m.correct_index")).count("md5(") == 1
    for r in out.collect():
        if r.options is None:
            assert r.m.options is None and r.m.correct_index == 0
            continue
        assert sorted(r.m.options) == sorted(r.options)
        if 0 <= r.answer < len(r.options):
            assert r.m.options[r.m.correct_index] == r.options[r.answer]
        else:
            assert r.m.correct_index == 0


def test_results_are_dealt_by_document_once(spark, sf):
    docs = K.courses(spark, sf)
    flat = H.flatten(docs, "capsule")
    results = flat.select("course_id", "entity_path", "capsule.items", F.lit(True).alias("success"))
    plan = H.put_back(docs, results)._jdf.queryExecution().sparkPlan().toString()
    full = H.put_back(docs, results)._jdf.queryExecution().executedPlan().toString()
    assert "entity_path" in plan and not any("entity_path" in line for line in full.splitlines() if "Exchange hashpartitioning" in line)
