"""Personal data, quality rules, licenses, URLs and tool calls against brute force on small rows."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import chat_tools, licenses, pii, quality_rules, url_filter

TEXTS = [
    "mail a..b@c.com.x_y@z.org ip 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111-1111 1111 +1 (988) 555-2485",
    "é ü 4111 1111 1111 1111 / 4111111111111112 --  5500-0000-0000-0004 1234 5678", None, "", " \n\t ", "@ a@ @b a@b a@b. a@b.c",
    "IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789", "000000000000000000000000000000001.2.3.255 1.2.3.256 1.2.3", "+12 +1234567890123456 +49 30 1234567)",
    "1 " * 5000, "a@b" + ".c" * 5000, "9" * 30000, "x" * 50000, "1.2.3.4 " * 50,
]


def rows(spark, texts=TEXTS):
    """Extra columns with clashing names ride along."""
    made = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(made, "doc_id long, text string, pii_spans string, n_words int").repartition(3)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    for kind, pattern, good in kinds:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if good(m)]
    return out


def test_personal_data_equals_plain_patterns(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 20000]
    for r in pii.report(rows(spark, texts)).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r["doc_id"]][:80]
        assert r["spans"].split(",")[: len(want)] == (want or r["spans"].split(",")[:0])


def test_long_runs_and_repeated_rows_pass(spark):
    found = pii.report(rows(spark).union(rows(spark)))
    assert found.count() == 2 * len(TEXTS) and found.distinct().count() == len(TEXTS)
    assert pii.report(rows(spark).limit(0)).count() == 0


def test_added_kinds_and_redaction(spark):
    r = {x["doc_id"]: x for x in pii.report(rows(spark)).collect()}
    assert r[6]["spans"] == "iban:5:32,national_id:38:49" and r[6]["n_iban"] == 1
    clean = pii.redact(rows(spark))
    assert clean.columns == ["doc_id", "text", "pii_spans", "n_words"]
    got = {x["doc_id"]: x["text"] for x in clean.collect()}
    assert got[6] == "IBAN <iban>, ssn <national_id>" and got[2] is None and got[3] == "" and got[12] == TEXTS[12]


def repeated(words):
    places, seen = set(), {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            places |= {i + j for i in at for j in range(8)}
    return len(places)


def test_quality_rules_equal_brute_force(spark):
    prose = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    texts = [*TEXTS, prose, prose + "\n" + prose, prose + " x " + prose.upper(), "a b " * 3000, prose + " #*$%&|<>" * 3, f"{prose}\n" * 4 + "y", "aaaa " * 8, "b " * 9, f"same line here\n{prose}\n same line here\nsame line here"]
    got = {r["doc_id"]: r for r in quality_rules.judge(rows(spark, texts)).collect()}
    for i, text in enumerate(texts):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, rep = len(w), repeated(w)
        want = (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, t[:60]
        assert not (r["base_failed"] and r["kept"])
    assert got[len(TEXTS)]["kept"] and not got[len(TEXTS) + 4]["kept"]
    assert quality_rules.judge(rows(spark).limit(0)).count() == 0


def test_rules_are_ordered_by_rejections_per_cost(spark):
    rules = quality_rules.default_rules()
    shouting = rows(spark, ["ABC DEF GHI " * 20] * 50)
    assert quality_rules.order_rules(shouting, rules)[0].name == "shouting"
    assert quality_rules.order_rules(shouting.limit(0), rules) == rules


def test_licenses(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "cc by cc by x MIT\nLicense", None, "", "all rights",
             "Licensed under the Apache License, Version 2.1", licenses.TEMPLATES[1][1].replace("[[", "").replace("]]", "").replace("{{holder:1-12}}", "Ann Ex"), "gnu " * 30000]
    got = {r["doc_id"]: r for r in licenses.report(rows(spark, texts)).collect()}
    assert [(got[i]["base_labels"], got[i]["labels"], got[i]["score"], got[i]["first_word"], got[i]["last_word"], got[i]["n_base"]) for i in range(9)] == [
        ("gpl", "gpl", 1.0, 6, 6, 1), ("cc-by", "cc-by,cc-by-nc", 1.0, 2, 2, 1), ("cc-by,mit", "cc-by,mit", 0.5, 0, 5, 3), ("", "", 0.0, None, None, 0),
        ("", "", 0.0, None, None, 0), ("", "", 0.0, None, None, 0), ("apache", "apache", 0.5, 3, 3, 1), ("mit", "mit", 1.0, 0, 0, 1), ("", "", 0.0, None, None, 0)]
    assert got[8]["n_words"] == 30000 and licenses.report(rows(spark).limit(0)).count() == 0


def test_template_markup():
    a = licenses.Automaton("x", "one [[two [[three]]]] {{gap:0-2}} four {{n:1-1#}}")
    assert [a.longest(t.split(), 0) for t in ("one four 1", "one two four 1", "one two three x y four 2", "one x y z four 1", "one four x", "two four 1")] == [3, 4, 7, -1, -1, -1]
    with pytest.raises(ValueError):
        licenses.Automaton("x", "one [[two")
    with pytest.raises(ValueError, match="mandatory"):
        licenses.Automaton("x", "{{any:1-2}} [[one]]")


def _readings(markup, words):
    """Longest readings from each place by a backtracking pattern, one per end: no automaton involved."""
    pattern = re.sub(r"\{\{[a-z]+:(\d+)-(\d+)(#?)\}\}", lambda m: ("<D>" if m[3] else "<A>") + f"<{m[1]},{m[2]}>", markup)
    pattern = re.sub(r"[a-z]+", lambda m: f"{m[0]} ", pattern).replace("[[", "(?:").replace("]]", ")?").replace("<D>", r"(?:\d+_)").replace("<A>", r"(?:\S+?_)")
    pattern = re.sub(r"<(\d+,\d+)>", r"{\1}", pattern.replace(" ", "").replace("_", " "))
    for word in {"one", "two", "three", "four"}:
        pattern = pattern.replace(word, f"(?:{word} )")
    whole = re.compile(f"(?:{pattern})")
    ends = {}
    for i in range(len(words)):
        for j in range(len(words), i, -1):
            if whole.fullmatch("".join(w + " " for w in words[i:j])):
                ends.setdefault(j, i)
                break
    return sorted((i, j) for j, i in ends.items())


@pytest.mark.parametrize("markup", [
    "{{who:1-2}} one two", "[[{{who:0-3}} two]] one", "{{no:1-2#}} one [[two|three]] {{x:0-2}} four", "one [[two [[three]]]] {{x:0-2}} four", "[[one|two {{x:1-1}}]] three {{no:1-1#}}",
    "{{a:1-1}} [[one]] {{b:0-1#}} two [[{{c:1-2}} two]]",
])
def test_templates_equal_brute_force(markup):
    draw = random.Random(markup)
    scanner = licenses.Scanner((("x", markup),), {})
    met = 0
    for _ in range(400):
        words = draw.choices(["one", "two", "three", "four", "7", "x"], k=draw.randint(0, 12))
        want = _readings(markup, words)
        assert [(i, j) for _, i, j in scanner.scan(words)[1]] == want, words
        met += bool(want)
    assert met > 10


def test_templates_ask_for_their_disclaimers():
    scanner = licenses.Scanner()
    for label, markup in licenses.TEMPLATES:
        if label in ("mit", "bsd", "isc") and "WARRANTIES" in markup:
            body = re.sub(r"\[\[DISCLAIMS\|DISCLAIM\]\]", "DISCLAIMS", re.sub(r"\{\{[a-z]+:\d+-\d+#?\}\}", "Ann Ex", markup)).replace("[[", "").replace("]]", "")
            words = licenses.WORD.findall(body.lower())
            assert (label, len(words)) in {(a, j) for a, _, j in scanner.scan(words)[1]}
            changed = ["no" if w == "any" else w for w in words]
            assert label not in {a for a, _, _ in scanner.scan(changed)[1]}
            assert label not in {a for a, _, _ in scanner.scan(words[:len(words) // 2])[1]}


def test_url_rules_and_trees(spark):
    urls = [f"http://site{i}.example.{s}/en/{i}" for i in range(60) for s in ("com", "org")] + [f"https://casino-win{i}.example.com/en/{i}" for i in range(30)]
    odd = [None, "", "no scheme", "http://A.NET", "http://A.net/", "x://b.example.NET/en/", "x://xnet/", "http://example.com/de/?q", "http://a.org/fr#", "http://a.org/fr/#", "http://h?x=1://y/z", "http://" + "a." * 5000 + "org/fr/1"]
    pages = spark.createDataFrame(list(enumerate(urls + odd)), "page_id long, url string").withColumn("host", F.lit("clash"))
    model = url_filter.fit(url_filter.hand_labels(pages))
    got = {r["page_id"]: r for r in url_filter.judge(pages, model).collect()}
    assert all(got[i]["verdict"] == ("block" if "casino" in u else "allow") for i, u in enumerate(urls))
    n = len(urls)
    assert [(got[n + i]["host"], got[n + i]["path"], got[n + i]["rule"]) for i in range(11)] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.net", "", None), ("a.net", "/", "net/"), ("b.example.net", "/en/", "example.net/en/"), ("xnet", "/", None),
        ("example.com", "/de/", "example.com/de/"), ("a.org", "/fr", None), ("a.org", "/fr/", "org/fr/"), ("h", "", None)]
    assert got[n + 11]["rule"] == "org/fr/"
    assert url_filter.fit(url_filter.hand_labels(pages.limit(0))).trees == [] and url_filter.judge(pages.limit(0), model).count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", "t", '{"y":2, "x":"é"}', ["b"]), (1, 0, "b", "t", '{"x":"1"}', None), (1, 0, "c", "t", '{"x":3}', ["a"]), (1, 2, "d", "u", "{}", ["a"]), (1, 2, "e", "t", "[1]", ["zz"]),
         (1, 2, "f", "t", '{"x":""}', ["g"]), (1, 2, "g", "t", '{"x":""}', ["f"]), (2, 0, "a", "t", None, []), (1, 0, "a", "t", '{"y":2, "x":"é"}', ["b"]), (None, 0, "q", "t", "{}", []), (1, None, "q", "t", "{}", [])],
        "conv_id long, turn long, call_id string, name string, arguments string, waits_for array<string>")
    results = spark.createDataFrame([(1, 1, "a", "late \"x\"\n"), (1, 1, "a", "z"), (1, 1, "none", "n"), (2, 1, "a", None), (1, 3, "d", "r"), (None, 1, "a", "x")], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame([("t", '{"type":"object","required":["x"],"properties":{"x":{"type":"string"},"y":{"type":"integer"}}}'), (None, "{}")], "name string, schema string")
    got = {(r["conv_id"], r["call_id"]): r for r in chat_tools.link(calls, results, schemas).collect()}
    assert {k: (v["status"], v["level"]) for k, v in got.items()} == {
        (1, "a"): ("ok", 1), (1, "b"): ("no_result", 0), (1, "c"): ("invalid", 2), (1, "d"): ("unknown_tool", 0), (1, "e"): ("missing", 0), (1, "f"): ("cycle", None),
        (1, "g"): ("cycle", None), (2, "a"): ("invalid", 0), (1, "none"): ("orphan", None)}
    assert json.loads(got[1, "a"]["line"]) == {"arguments": {"x": "é", "y": 2}, "id": "a", "name": "t", "result": "late \"x\"\n"}
    messages = {(r["conv_id"], r["turn"]): [x["id"] for x in json.loads(r["messages"])] for r in chat_tools.format_messages(calls, results, schemas).collect()}
    assert messages == {(1, 0): ["b", "a", "c"], (1, 1): ["none"], (1, 2): ["d", "e", "f", "g"], (2, 0): ["a"]}
    assert chat_tools.format_messages(calls.limit(0), results.limit(0), schemas.limit(0)).count() == 0


def test_schema_check():
    s = {"type": "object", "properties": {"a": {"type": ["integer", "null"], "minimum": 1, "maximum": 5}, "b": {"enum": ["x"]}, "c": {"type": "array", "items": {"type": "number"}}}, "additionalProperties": False}
    good = [{}, {"a": 1}, {"a": None}, {"a": 5.0}, {"b": "x"}, {"c": [1, 2.5]}]
    bad = [1, {"a": 0}, {"a": True}, {"a": 1.5}, {"b": "y"}, {"c": ["1"]}, {"d": 1}]
    assert all(chat_tools.fits(g, s) for g in good) and not any(chat_tools.fits(b, s) for b in bad)
    assert chat_tools.canonical({"b": [1], "a": "é"}) == '{"a":"é","b":[1]}'
