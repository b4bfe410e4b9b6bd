import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import naming as N
from lectern.functions import replies as R
from lectern.functions import severity as S
from lectern.functions import text as T
from lectern.functions.fuzzy import window_similarity


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("given, wanted", [
    ("Multiple Choice", "multiple_choice"), ("Drag and Drop", "drag_and_drop"), ("  fill  blank  ", "fill_blank"),
    ("Case-Study (Complex)", "case_study_complex"), ("", ""), ("   ", ""), ("SAA-C03", "saa_c03"),
])
def test_type_name(spark, given, wanted):
    assert one(spark, given, N.type_name) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("First Aid", "First_Aid"), ("_a", "aaa"), ("", "aaa"), ("x" * 70, "x" * 63), ("é!", "aaa"), ("a b-", "a_b"),
])
def test_collection_name(spark, given, wanted):
    assert one(spark, given, N.collection_name) == wanted


@pytest.mark.parametrize("given, wanted", [
    ('```json\n{"a": 1}\n```', '{"a": 1}'), ("```\nx\ny", "x\ny"), ("  plain ", "plain"), ("```json\n```", ""), ("a\n```", "a\n```"),
    ("```\n{}\n  ```  ", "{}"), ("```", ""),
])
def test_strip_fences(spark, given, wanted):
    assert one(spark, given, R.strip_fences) == wanted


def test_unicode_terms(spark):
    assert one(spark, "Élan vital für Straße 1234 the should", T.key_terms) == ["élan", "vital", "straße", "1234"]
    assert one(spark, "Élan 1234 patient", T.concept_terms) == ["élan"]


def test_relevance_caps_and_default(spark):
    assert one(spark, "x", lambda t: T.relevance(t, F.lit("the a"), F.lit("beginner"))) == 0.5
    assert one(spark, "You should check vital signs first", lambda t: T.relevance(t, F.lit("vital signs"), F.lit("advanced"))) == 1.0


def test_quotable_offsets(spark):
    text = "Short one. The crew must always wait for the power company. Is it a question that must be asked by us?"
    found = one(spark, text, lambda t: T.quotable_sentences(t, F.lit("power company")))
    assert [f.sentence for f in found] == ["The crew must always wait for the power company."]
    assert text[found[0].start_char:found[0].end_char] == found[0].sentence
    assert found[0].score == pytest.approx(0.3 + 0.1)  # "company." keeps its dot, so one shared word


@pytest.mark.parametrize("needle, haystack, wanted", [
    ("", "abc", 0.0), ("abc", "", 0.0), (None, "abc", None), ("abc", None, None),
    ("abcdefghij", "xxxabcdefghijxxx", 1.0), ("abcdefghij", "abcdeXghij", 0.9), ("abcdefghij", "--abXdeXghXj--", 0.7), ("é😀ab", "zz é😀aX", 0.75),
    ("abcdefghij", "abcd", 0.4), ("aaaa", "bbbb", 0.0),
    ("abcdefghijklmnopqrst", "abcdefghijklmnopqrsX abcdefghijklmnopqrst", 0.95),  # the first good window counts
    ("abcdefghijklmnopqrst", "abcdefghijklmnopqrXX abcdefghijklmnopqrst", 1.0),
])
def test_window_similarity_of_planted_changes(needle, haystack, wanted):
    assert window_similarity(needle, haystack) == (wanted if wanted is None else pytest.approx(wanted))


def test_window_similarity_counts_changed_places():
    draw = random.Random(5)
    for _ in range(100):
        needle = "".join(draw.choice("abcdefgh") for _ in range(40))
        places = draw.sample(range(40), draw.randint(0, 12))
        if 1 <= len(places) <= 2:  # such a window may not be the first good one
            continue
        changed = "".join("#" if i in places else c for i, c in enumerate(needle))
        assert window_similarity(needle, "." * draw.randint(0, 50) + changed + "." * draw.randint(0, 50)) == pytest.approx(1 - len(places) / 40)


def test_worst_severity_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "s string")
    assert df.agg(S.worst("s").alias("w")).first()["w"] == "passed"
    df = spark.createDataFrame([("minor",), ("critical",), ("major",)], "s string")
    assert df.agg(S.worst("s").alias("w")).first()["w"] == "critical"


def test_content_hash_order(spark):
    rows = [(None, ["http://x/a?md5=ABC&k=1"], "ABC"), ("http://h/md5/ff00/x", [], "ff00"), (None, ["q", "http://h/main/99/aa/f"], "99"), (None, None, None)]
    df = spark.createDataFrame(rows, "d string, m array<string>, w string").select(N.content_hash("d", "m").alias("h"), "w")
    assert all(r.h == r.w for r in df.collect())
