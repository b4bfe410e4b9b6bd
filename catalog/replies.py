"""Queries that read replies and write requests.

Replies are built from the given texts as a model would send them (fenced JSON); some rows are
cut off so that the failure side has rows too.
"""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from catalog.base import (
    SQL_LINKS, SQL_SOURCE_ITEMS, as_json_reply, links, plain, source_items, sql_list, sql_sentences, sql_words, table,
)
from lectern.functions import lexicon as lex
from lectern.functions import replies as R
from lectern.functions import text as T
from lectern.operators import ambiguity as B
from lectern.operators import distractors as D
from lectern.operators import exam_format as E
from lectern.operators import ingest as I
from lectern.operators import item_plans as P
from lectern.operators import metrics as M
from lectern.operators import questions as Qn
from lectern.operators import requests as Req
from lectern.operators import validation as V
from lectern.operators.durable import durable


def _turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), "conv_id", "turn", "role", "text")


def _cut(reply, every: int = 5):
    """Every n-th reply is cut off in the middle of its JSON."""
    return F.when(F.col("item_id") % every == 0, F.substring(reply, 1, 20)).otherwise(reply)


def fence_strip(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    kind = F.col("item_id") % 3
    fenced = F.when(kind == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n``` "))).when(kind == 1, F.concat(F.lit("```\n"), "text")).otherwise(F.col("text"))
    return plain(rows.select("item_id", F.md5(R.strip_fences(fenced)).alias("digest")))


_S = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"


def _content_replies(spark, sf_dir):
    s = T.sentences("text")
    rows = _turns(spark, sf_dir).withColumn("s", s)
    reply = as_json_reply(F.get("s", F.lit(0)).alias("stem"), F.slice("s", 2, 4).alias("options"), F.when(F.col("item_id") % 2 == 0, 1).alias("correct_index"), F.concat_ws(" ", "text", "text", "text", "text").alias("source_summary"))
    return rows.select("item_id", _cut(reply).alias("reply"))


def reply_ingest(spark, sf_dir):
    good, bad = I.ingest_content(_content_replies(spark, sf_dir))
    a = good.select("item_id", F.lit(True).alias("success"), F.md5("stem").alias("digest"), F.size("options").alias("options"), "correct_index", F.length("source_summary").alias("summary_chars"), "explanation")
    zero = F.lit(0)
    b = bad.select("item_id", "success", F.md5(F.lit("")).alias("digest"), zero.alias("options"), zero.alias("correct_index"), zero.alias("summary_chars"), F.col("error").alias("explanation"))
    return plain(a.unionByName(b))


def fill_items(spark, sf_dir):
    good, _ = I.ingest_content(_content_replies(spark, sf_dir))
    rows = _turns(spark, sf_dir).select("item_id", F.lit(None).cast("string").alias("content"), T.words_array(["a", "b"]).alias("options"), F.lit(0).alias("correct_answer_index"), F.lit("old").alias("explanation"), F.lit("pending").alias("generation_status"))
    filled = I.fill_items(rows, good)
    return plain(filled.groupBy("generation_status").agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("options").cast("long")).alias("options"), F.count("content").alias("filled")))


def level_ingest(spark, sf_dir):
    """Labs in a reply, two per text; the second lacks its objective in every seventh reply."""
    rows = _turns(spark, sf_dir).withColumn("s", F.get(T.sentences("text"), F.lit(0)))
    lab = lambda i, objective: F.struct(F.lit(f"lab_{i}").alias("lab_id"), F.col("role").alias("title"), objective.alias("objective"), F.lit("guided").alias("lab_type"), T.words_array(["tool"]).alias("tools_required"))
    second = F.when(F.col("item_id") % 7 > 0, F.col("s"))
    replies = rows.select(F.col("item_id").alias("parent_id"), "item_id", as_json_reply(F.array(lab(1, F.col("s")), lab(2, second)).alias("labs")).alias("reply")).withColumn("reply", _cut(F.col("reply")))
    good, bad = I.ingest_level(replies, "labs")
    a = good.select("parent_id", F.col("lab_id").alias("entry"), F.md5("objective").alias("note"), F.size("tools_required").alias("tools"))
    b = bad.select("parent_id", F.lit("failed").alias("entry"), F.col("error").alias("note"), F.lit(-1).alias("tools"))
    return plain(a.unionByName(b))


def overview_ingest(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(
        F.col("item_id").alias("course_id"), "item_id",
        as_json_reply(
            F.struct(F.col("text").alias("course_description"), F.lit(12.5).alias("total_estimated_study_hours")).alias("overview"),
            F.array(F.struct(F.when(F.col("item_id") % 4 > 0, F.lit("MCQ")).alias("question_type_name"))).alias("question_type_guides"),
        ).alias("reply"),
    )
    out = I.ingest_overview(rows)
    return plain(out.select("course_id", "success", F.coalesce("overview.course_description", F.lit("")).alias("description"), F.coalesce(F.size("guides"), F.lit(0)).alias("guides")))


def distractor_ingest(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    row = lambda p, pattern: F.struct(p.alias("text"), pattern.alias("pattern"), F.lit(None).cast("double").alias("plausibility"))
    reply = as_json_reply(F.array(row(F.col("role"), F.lit("opposite")), row(F.col("text"), F.when(F.col("turn") % 2 == 0, "nonsense").otherwise("wrong_sequence"))).alias("distractors"))
    replies = rows.select("item_id", F.when(F.col("turn") % 3 == 0, "advanced").otherwise("beginner").alias("difficulty"), _cut(reply).alias("reply"))
    out = D.ingest_distractors(replies)
    return plain(out.select("item_id", "success", "balance_check", F.transform("distractors", lambda d: d["pattern"]).alias("patterns"), F.transform("distractors", lambda d: F.round(d["plausibility"], 1).cast("string")).alias("plausibility")))


def _plan_replies(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    t, n = F.col("turn"), F.col("item_id")
    wrong = lambda i, reason, fact, source: F.struct(F.lit(f"Wrong {i}").alias("text"), F.lit("nonsense").alias("tag"), reason.alias("failure_reason"), F.lit("because").alias("why_wrong"), fact.alias("stem_fact_violated"), source.alias("plausibility_source"))
    text = lambda v: F.lit(v)
    distractors = F.array(
        wrong(1, F.when(n % 2 == 0, "too_generic").otherwise("exceeds_scope"), text("the breaker is inside"), text("habit")),
        wrong(2, text("unheard_of"), F.when(n % 3 == 0, "").otherwise("the patient is far away"), F.when(n % 4 > 0, "hurry")),
        wrong(3, text("wrong_sequence"), text("dispatch was called"), text("order")),
    )
    locks = F.array(F.struct(F.when(t % 2 == 0, "nothing").otherwise("time").alias("lock_type"), F.col("text").alias("constraint_text"), T.words_array(["wrong 1", "wrong 2 and more"]).alias("eliminates_options")))
    reply = as_json_reply(
        F.when(t % 3 == 0, "first_action").when(t % 3 == 1, "strange").otherwise("definition").alias("question_type"),
        F.when(n % 7 > 0, locks).alias("decision_locks"), F.lit("Do it").alias("correct_option_text"),
        F.when(n % 11 > 0, F.concat(F.lit("It is always so: "), "text")).alias("discriminating_factor"),
        F.array(F.struct(F.lit("Q1").alias("quote_id"), F.lit("claim").alias("supports_claim")), F.struct(F.concat(F.lit("Q"), (n % 3).cast("string")).alias("quote_id"), F.lit("x").alias("supports_claim"))).alias("support_mapping"),
        distractors.alias("distractors"), T.words_array(["a"]).alias("scope_tags"),
    )
    return rows.select("item_id", F.col("text").alias("learning_target"), _cut(reply).alias("reply"), F.coalesce(F.get(T.sentences("text"), F.lit(0)), F.lit("")).alias("stem"))


def _quote_table(spark, sf_dir):
    return _turns(spark, sf_dir).filter("turn % 2 = 0").select("item_id", F.lit("Q1").alias("quote_id"))


def plan_ingest(spark, sf_dir):
    plans = P.plans_or_fallback(_plan_replies(spark, sf_dir).drop("stem"), _quote_table(spark, sf_dir), ["s1", "s2", "s3"])
    return plain(plans.select(
        "item_id", "question_type", "is_fallback", "scope_tags", P.required_quote_ids().alias("required"), F.size("decision_locks").alias("locks"),
        F.transform("distractors", lambda d: d["failure_reason"]).alias("reasons"), F.transform("decision_locks", lambda x: x["lock_type"]).alias("lock_types"),
    ))


def plan_issues(spark, sf_dir):
    plans = P.plans_or_fallback(_plan_replies(spark, sf_dir).drop("stem"), _quote_table(spark, sf_dir), ["s1", "s2", "s3"])
    judged = P.plan_issues(plans, _quote_table(spark, sf_dir)).withColumn("ambiguity", P.plan_ambiguity_issues())
    return plain(judged.select("item_id", "issues", "ambiguity"))


def strict_ambiguity(spark, sf_dir):
    replies = _plan_replies(spark, sf_dir)
    plans = P.ingest_plans(replies.drop("stem")).join(replies.select("item_id", "stem"), "item_id")
    return plain(B.strict_verdict(plans).select("item_id", F.size("lock_issues").alias("lock_issues"), "distractor_issues", F.size("factor_issues").alias("factor_issues"), "passes", "confidence"))


def query_plan_ingest(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    query = lambda text, intent: F.struct(text.alias("query_text"), intent.alias("intent"))
    reply = as_json_reply(F.array(query(F.col("text"), F.lit("quote_hunt")), query(F.col("role"), F.when(F.col("turn") % 2 == 0, "other").otherwise("synonym_variant")), query(F.lit("x"), F.lit("scenario_context"))).alias("queries"))
    replies = rows.select("item_id", F.col("text").alias("learning_target"), F.lit("Topic").alias("topic_name"), F.col("role").alias("subtopic_name"), _cut(reply).alias("reply"))
    plans = P.query_plans_or_fallback(replies)
    precise = P.precision_queries(plans).select("item_id", F.lit("precise").alias("kind"), "plan_pos", "query_text", "priority")
    broad = P.broadening_queries(plans).select("item_id", F.lit("broad").alias("kind"), "plan_pos", "query_text", "priority")
    return plain(precise.unionByName(broad))


def fallback_keywords(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("item_id", F.col("text").alias("learning_target"), F.lit("T").alias("topic_name"), F.lit("S").alias("subtopic_name"))
    return plain(P.fallback_queries(rows).select("item_id", "must_include_keywords", F.size("queries").alias("queries")))


def two_pass(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    items = rows.select("item_id", (F.col("turn") % 4).cast("int").alias("correct_index"))
    first = rows.select("item_id", _cut(as_json_reply((F.col("item_id") % 4).cast("int").alias("selected_index"), F.lit(0.9).alias("confidence"))).alias("reply"))
    second = rows.select("item_id", as_json_reply((F.col("conv_id") % 2 == 0).alias("is_defensible"), F.lit("d").alias("defense")).alias("reply"))
    return plain(B.two_pass_verdict(items, first, second).drop("reasoning"))


def all_options(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    items = rows.select("item_id", (F.col("turn") % 4).cast("int").alias("correct_index"))
    option = lambda i: F.struct(F.lit(i).alias("index"), (F.col("item_id") % (i + 3) == 0).alias("is_defensible"))
    replies = rows.select("item_id", _cut(as_json_reply(F.array(*[option(i) for i in range(4)]).alias("defensible_options"), F.when(F.col("conv_id") % 3 == 0, "ambiguous").otherwise("clear").alias("overall_clarity"))).alias("reply"))
    return plain(B.all_options_verdict(items, replies))


def review_replies(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    issue = F.struct(F.lit("CLARITY").alias("rule_name"), F.when(F.col("turn") % 2 == 0, "MAJOR").otherwise("odd").alias("severity"), F.when(F.col("turn") % 3 == 0, "unclear").alias("description"))
    replies = rows.select("item_id", _cut(as_json_reply(F.filter(F.array(issue), lambda _: F.col("turn") > 0).alias("issues"))).alias("reply"))
    found = V.review_issues(replies).select("item_id", "severity", "rule_name", "description")
    ground = rows.select("item_id", _cut(as_json_reply((F.col("conv_id") % 2 == 0).alias("is_grounded"), F.col("role").alias("evidence"))).alias("reply"))
    items = rows.select("item_id", F.array("role").alias("chunk_ids"), F.when(F.col("turn") % 4 > 0, F.col("text")).alias("content"), F.array("role").alias("options"))
    more = V.grounding_issues(items, ground).select("item_id", "severity", "rule_name", "description")
    return plain(found.unionByName(more))


def anchored_ingest(spark, sf_dir):
    out = I.ingest_anchored(_content_replies(spark, sf_dir))
    return plain(out.select("item_id", F.coalesce("correct_answer", F.lit("")).alias("correct_answer")))


# --- exam formats and question types --------------------------------------------------------------


def _exams(spark, sf_dir):
    """Every turn as an exam of two components."""
    rows = _turns(spark, sf_dir)
    n = F.col("item_id")
    domain = F.struct(F.col("role").alias("name"), F.when(n % 2 == 0, 10.0).alias("weight_min_pct"), F.when(n % 3 > 0, 20.0).alias("weight_max_pct"), F.when(n % 4 == 0, 15.5).alias("weight_pct"))
    kind = lambda name: F.struct(F.lit(name).alias("name"), F.when(n % 5 > 0, F.lit(f"The {name}")).alias("display_name"), F.lit(True).alias("is_tei"))
    component = lambda name, count, minutes, ways: F.struct(F.lit(name).alias("name"), count.alias("num_questions"), F.lit(99).alias("num_questions_max"), minutes.alias("time_limit_minutes"), T.words_array(ways).alias("delivery_methods"), F.array(domain).alias("domains"), F.array(kind("mcq")).alias("item_classes"))
    reply = as_json_reply(
        F.lit(None).cast("string").alias("certification_name"),
        F.array(component("cognitive", F.when(n % 3 == 0, 70).cast("int"), F.lit(None).cast("int"), ["online", "center"]), component("practical", F.lit(5), F.lit(45), ["center", "site"])).alias("exam_components"),
        F.array(F.struct(F.lit("cost").alias("field"), n.alias("value"))).alias("source_facts"),
    )
    return rows.select("item_id", F.concat(F.lit("Exam "), n.cast("string")).alias("certification"), _cut(reply).alias("reply"))


def exam_flatten(spark, sf_dir):
    flat = E.flatten_components(E.read_components(_exams(spark, sf_dir)))
    return plain(flat.select(
        "certification_name", "num_questions", "time_limit_minutes", "delivery_methods",
        F.transform("domains", lambda d: F.coalesce(d["weight_pct"].cast("string"), F.lit("none"))).alias("weights"), F.transform("question_types", lambda q: q["name"]).alias("types"),
    ))


def exam_text(spark, sf_dir):
    rows = E.read_components(_exams(spark, sf_dir)).select("certification_name", Req.exam_structure("exam_components").alias("t"))
    return plain(rows.select("certification_name", F.size(F.split("t", "\n")).alias("lines"), F.get(F.split("t", "\n"), F.lit(1)).alias("second_line")))


def flat_exam(spark, sf_dir):
    """Question types mixed: names and objects in one list."""
    rows = _turns(spark, sf_dir)
    reply = F.concat(F.lit('{"num_questions": 10, "question_types": ["MCQ", {"name": "'), "role", F.lit('", "purpose": "p"}, 7], "domains": [{"name": "d", "weight_pct": '), F.col("turn").cast("string"), F.lit("}]}"))
    out = E.read_flat(rows.select(F.col("item_id").cast("string").alias("certification"), reply.alias("reply")))
    return plain(out.select("certification_name", "num_questions", F.transform("question_types", lambda t: t["name"]).alias("types"), F.get("domains", F.lit(0))["weight_pct"].alias("weight")))


def weight_repair(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    kind = F.col("item_id") % 4
    reply = F.when(kind == 0, '{"domain_weight_pct": 0.25}').when(kind == 1, '{"domain_weight_pct": null}').when(kind == 2, '{"other": 1}').otherwise('{"domain_weight_pct": 30}')
    domain = F.when(F.col("turn") % 2 == 0, 12.0)
    return plain(rows.select("item_id", E.repaired_weight(reply, domain, F.lit(10.0), F.lit(20.0)).alias("weight")))


def question_parse(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("s", T.sentences("text"))
    kind = F.when(F.col("turn") % 2 == 0, "Multiple Choice").otherwise("multiple-response")
    choices = F.transform("s", lambda x, i: F.struct(F.chr(i + 65).alias("label"), x.alias("text"), (i == 1).alias("is_correct")))
    reply = as_json_reply(kind.alias("question_type"), F.get("s", F.lit(0)).alias("stem"), choices.alias("choices"), F.lit("B").alias("correct_label"), T.words_array(["A", "B"]).alias("correct_labels"), F.array(F.lit(1), F.lit(5), F.lit(0)).alias("source_indices"))
    parsed = Qn.parse_questions(rows.select("item_id", "role", _cut(reply).alias("reply")))
    sources = Qn.attach_sources("source_indices", F.array("role", F.lit("second")))
    return plain(parsed.select(
        "item_id", "question_type", F.coalesce(F.size("multiple_choice.choices"), F.lit(-1)).alias("single_choices"), F.coalesce("multiple_choice.correct_label", F.lit("")).alias("label"),
        F.coalesce(F.array_join("multiple_response.correct_labels", ","), F.lit("")).alias("labels"), sources.alias("sources"),
    ))


def stage_counts(spark, sf_dir):
    """Counts of a stage, taken while its rows are written: questions by type, read and unread replies."""
    rows = _turns(spark, sf_dir)
    kind = F.when(F.col("turn") % 3 == 0, "Multiple Choice").when(F.col("turn") % 3 == 1, "ordering").otherwise("riddle")
    replies = rows.select("item_id", _cut(as_json_reply(kind.alias("question_type"), F.col("text").alias("stem"))).alias("reply"))
    read = Qn.parse_questions(replies).select("item_id", "question_type", F.lit(True).alias("success"))
    unread = replies.filter(~R.is_object("reply")).select("item_id", F.lit(None).cast("string").alias("question_type"), F.lit(False).alias("success"))
    seen = Observation()
    durable(M.observe_stage(read.unionByName(unread), seen, kind="question_type", kinds=list(Qn.PAYLOADS)))
    counts = [(name, int(n)) for name, n in seen.get.items()]
    return spark.createDataFrame(counts, "measure string, n long")


def type_registry(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", F.lower("p_type"))).alias("name"))
    known = table(spark, sf_dir, "part").select(F.regexp_replace("p_name", " ", "_").alias("question_type")).distinct().withColumn(
        "definition", F.struct(T.words_array(["stem"]).alias("fields"), F.lit(4).alias("choice_count"), F.lit("all_or_nothing").alias("scoring"))
    )
    return plain(Qn.extend_registry(known, names).select("question_type", "definition.scoring"))


# --- requests ----------------------------------------------------------------------------------------


def content_requests(spark, sf_dir):
    chunks = links(spark, sf_dir).select("item_id", "chunk_pos", F.col("source").alias("book_title"), F.array((F.col("chunk_id") % 9).cast("int")).alias("pages"), "text")
    out = Req.content_requests(source_items(spark, sf_dir), chunks)
    return plain(out.select("item_id", F.md5("request").alias("digest"), "tokens"))


def anchored_requests(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("s", T.sentences("text"))
    anchor = F.transform("s", lambda x: F.struct(x.alias("text"), F.array(F.lit(1), F.lit(2)).alias("page_numbers")))
    items = rows.select("item_id", F.col("role").alias("learning_target"), F.lit("advanced").alias("difficulty"), anchor.alias("anchors"), F.array(F.struct(F.col("text"), F.array().cast("array<int>").alias("pages"))).alias("chunks"))
    return plain(Req.anchored_requests(items).select("item_id", F.md5("request").alias("digest"), "tokens"))


def query_requests(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("item_id", F.lit("T").alias("topic_name"), F.col("role").alias("subtopic_name"), F.col("text").alias("learning_target"), F.when(F.col("turn") > 0, T.split_words("text")).alias("sections"))
    return plain(Req.query_requests(rows).select("item_id", F.md5("request").alias("digest"), "tokens"))


def quote_blocks(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("s", T.sentences("text"))
    quotes = F.transform("s", lambda x, i: F.struct(F.concat(F.lit("Q"), i + 1).alias("quote_id"), x.alias("text"), F.array(i).alias("page_numbers"), F.when(i % 2 == 0, F.col("role")).alias("section_heading")))
    some = F.when(F.col("turn") > 0, quotes)
    return plain(rows.select("item_id", F.md5(Req.quote_block(some)).alias("digest"), F.md5(Req.lettered_options("s")).alias("letters"), F.md5(Req.option_list("s")).alias("numbers")))


_ITEM = "conv_id * 100 + turn"
_OK = f"({_ITEM}) % 5 > 0"
SQL_TURNS = f"turns AS (SELECT {_ITEM} AS item_id, conv_id, turn, role, text, {sql_sentences('text')} AS s FROM conversations)"

_REASONS = "[CASE WHEN item_id % 2 = 0 THEN 'too_generic' ELSE 'exceeds_scope' END, 'too_generic', 'wrong_sequence']"

QUERIES = {
    "fence_strip": (fence_strip, f"SELECT {_ITEM} AS item_id, md5(CASE WHEN ({_ITEM}) % 3 = 0 THEN text WHEN ({_ITEM}) % 3 = 1 THEN rtrim(text, ' ' || chr(9) || chr(10) || chr(13)) ELSE {_S} END) AS digest FROM conversations"),
    "reply_ingest": (reply_ingest, f"""
WITH {SQL_TURNS}, w AS (SELECT *, concat_ws(' ', text, text, text, text) AS long FROM turns)
SELECT item_id, true AS success, md5(coalesce(s[1], '')) AS digest, len(s[2:5])::BIGINT AS options, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS correct_index,
  CASE WHEN len({sql_words('long')}) > 150 THEN length(array_to_string({sql_words('long')}[1:150], ' ')) + 3 ELSE length(long) END::BIGINT AS summary_chars, '' AS explanation FROM w WHERE item_id % 5 > 0
UNION ALL SELECT item_id, false, md5(''), 0, 0, 0, 'reply is not a JSON object' FROM w WHERE item_id % 5 = 0"""),
    "fill_items": (fill_items, f"""
WITH {SQL_TURNS} SELECT CASE WHEN item_id % 5 > 0 THEN 'success' ELSE 'pending' END AS generation_status, count(*) AS items,
  sum(CASE WHEN item_id % 5 > 0 THEN len(s[2:5]) ELSE 2 END)::BIGINT AS options, count(*) FILTER (item_id % 5 > 0) AS filled FROM turns GROUP BY 1"""),
    "level_ingest": (level_ingest, f"""
WITH {SQL_TURNS}
SELECT item_id AS parent_id, unnest(['lab_1', 'lab_2']) AS entry, md5(s[1]) AS note, 1::BIGINT AS tools FROM turns WHERE item_id % 5 > 0 AND item_id % 7 > 0 AND len(s) > 0
UNION ALL SELECT item_id, 'failed', CASE WHEN item_id % 5 = 0 THEN 'reply is not a JSON object' ELSE 'required key missing' END, -1 FROM turns WHERE item_id % 5 = 0 OR item_id % 7 = 0 OR len(s) = 0"""),
    "overview_ingest": (overview_ingest, f"""
SELECT {_ITEM} AS course_id, ({_ITEM}) % 4 > 0 AS success, CASE WHEN ({_ITEM}) % 4 > 0 THEN coalesce(text, '') ELSE '' END AS description, CASE WHEN ({_ITEM}) % 4 > 0 THEN 1 ELSE 0 END::BIGINT AS guides FROM conversations"""),
    "distractor_ingest": (distractor_ingest, f"""
WITH r AS (SELECT {_ITEM} AS item_id, {_OK} AS ok, turn % 3 = 0 AS adv, CASE WHEN turn % 2 = 0 THEN 'incomplete' ELSE 'wrong_sequence' END AS p2 FROM conversations)
SELECT item_id, ok AS success, CASE WHEN NOT ok THEN 'Generation failed' WHEN adv THEN 'Forbidden pattern used: opposite; Advanced has ' || CASE WHEN p2 = 'incomplete' THEN 2 ELSE 1 END || ' non-sequence distractors'
    ELSE 'Need 2 clearly wrong, have 1' || CASE WHEN p2 = 'wrong_sequence' THEN '; Forbidden pattern used: wrong_sequence' ELSE '' END END AS balance_check,
  CASE WHEN ok THEN 'opposite|' || p2 ELSE '' END AS patterns, CASE WHEN ok THEN '0.5|0.5' ELSE '' END AS plausibility FROM r"""),
    "plan_ingest": (plan_ingest, f"""
WITH r AS (SELECT {_ITEM} AS item_id, {_OK} AS ok, turn FROM conversations)
SELECT item_id, CASE WHEN NOT ok THEN 'factual' WHEN turn % 3 = 0 THEN 'first_action' WHEN turn % 3 = 1 THEN 'factual' ELSE 'definition' END AS question_type, NOT ok AS is_fallback,
  CASE WHEN ok THEN 'a' ELSE 's1|s2' END AS scope_tags, CASE WHEN ok THEN 'Q1|Q' || item_id % 3 WHEN turn % 2 = 0 THEN 'Q1' ELSE '' END AS required,
  CASE WHEN ok AND item_id % 7 > 0 THEN 1 ELSE 0 END::BIGINT AS locks,
  CASE WHEN ok THEN array_to_string({_REASONS}, '|') ELSE 'approaches_hazard|wrong_sequence|exceeds_scope' END AS reasons,
  CASE WHEN ok AND item_id % 7 > 0 THEN CASE WHEN turn % 2 = 0 THEN 'feasibility' ELSE 'time' END ELSE '' END AS lock_types FROM r"""),
    "plan_issues": (plan_issues, f"""
WITH r AS (SELECT {_ITEM} AS item_id, {_OK} AS ok, turn, turn % 2 = 0 AS has, text FROM conversations),
i AS (SELECT item_id, ok, text, list_filter(CASE WHEN ok THEN [
    CASE WHEN NOT has THEN 'unknown_quote: Q1' END, CASE WHEN NOT (has AND item_id % 3 = 1) THEN 'unknown_quote: Q' || item_id % 3 END,
    CASE WHEN turn % 3 = 0 AND item_id % 7 = 0 THEN 'missing_decision_lock' END, CASE WHEN item_id % 2 = 0 THEN 'shared_failure_reason: too_generic' END,
    CASE WHEN item_id % 3 = 0 THEN 'missing_stem_fact: 2' END, CASE WHEN item_id % 11 = 0 THEN 'missing_discriminating_factor' END]
  ELSE [CASE WHEN NOT has THEN 'no_support_mapping' END, 'missing_stem_fact: 1', 'missing_stem_fact: 2', 'missing_stem_fact: 3', 'missing_discriminating_factor', 'missing_correct_option'] END, lambda z: z IS NOT NULL) AS x,
  list_filter(CASE WHEN ok THEN [
    CASE WHEN turn % 3 = 0 AND item_id % 7 = 0 THEN 'not_eliminated: 1' END, CASE WHEN turn % 3 = 0 AND item_id % 7 = 0 THEN 'not_eliminated: 2' END, CASE WHEN turn % 3 = 0 THEN 'not_eliminated: 3' END,
    CASE WHEN item_id % 4 = 0 THEN 'no_plausibility: 2' END, CASE WHEN item_id % 11 > 0 THEN 'vague_factor: ' || list_filter({sql_list(lex.PLAN_VAGUE_PHRASES)}, lambda z: contains(lower('It is always so: ' || text), z))[1] END]
  ELSE ['no_plausibility: 1', 'no_plausibility: 2', 'no_plausibility: 3'] END, lambda z: z IS NOT NULL) AS y FROM r)
SELECT item_id, coalesce(array_to_string(x, '|'), '') AS issues, coalesce(array_to_string(y, '|'), '') AS ambiguity FROM i"""),
    "strict_ambiguity": (strict_ambiguity, f"""
WITH r AS (SELECT {_ITEM} AS item_id, turn, text, list_distinct(regexp_extract_all(lower(coalesce(({sql_sentences('text')})[1], '')), '[\\p{{L}}\\p{{N}}_]{{4,}}')) AS words FROM conversations WHERE {_OK}),
f AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{4,}}')), lambda z: NOT list_contains({sql_list(lex.LOCK_STOP_WORDS)}, z)) AS lw,
  CASE WHEN item_id % 11 > 0 THEN lower('It is always so: ' || text) ELSE '' END AS factor FROM r),
g AS (SELECT *, list_filter(list_distinct(regexp_extract_all(factor, '[\\p{{L}}\\p{{N}}_]{{4,}}')), lambda z: NOT list_contains({sql_list(lex.FACTOR_STOP_WORDS)}, z)) AS fw FROM f),
c AS (SELECT item_id,
  CASE WHEN turn % 3 > 0 THEN 0 WHEN item_id % 7 = 0 THEN 1 WHEN len(lw) < 2 THEN 0 ELSE (len(list_intersect(lw, words))::DOUBLE / len(lw) < 0.4)::INT END AS a,
  list_filter([CASE WHEN item_id % 2 = 0 THEN 'shared_reason: too_generic' END, CASE WHEN item_id % 3 = 0 THEN 'vague_fact_2' END], lambda z: z IS NOT NULL) AS b,
  CASE WHEN factor = '' THEN 1 ELSE len(list_filter({sql_list(lex.FACTOR_VAGUE_PHRASES)}, lambda z: contains(factor, z))) + (len(fw) >= 2 AND len(list_intersect(fw, words))::DOUBLE / greatest(len(fw), 1) < 0.3)::INT END AS d FROM g)
SELECT item_id, a::BIGINT AS lock_issues, coalesce(array_to_string(b, '|'), '') AS distractor_issues, d::BIGINT AS factor_issues, a + len(b) + d = 0 AS passes,
  round(CASE WHEN a + len(b) + d = 0 THEN 0.8 ELSE greatest(0.3, 1 - (a + len(b) + d) * 0.2) END, 6)::DOUBLE AS confidence FROM c"""),
    "query_plan_ingest": (query_plan_ingest, f"""
WITH r AS (SELECT {_ITEM} AS item_id, {_OK} AS ok, turn, role, text AS t FROM conversations),
p AS (SELECT item_id, 'precise' AS kind, unnest([0, 1]) AS plan_pos, unnest(['Topic ' || role || ' ' || t, t]) AS query_text, 1 AS priority FROM r WHERE NOT ok
  UNION ALL SELECT item_id, 'broad', 3, role || ' procedures assessment', 2 FROM r WHERE NOT ok
  UNION ALL SELECT item_id, CASE WHEN turn % 2 = 0 THEN 'precise' ELSE 'broad' END, 1, role, 1 FROM r WHERE ok
  UNION ALL SELECT item_id, 'broad', 2, 'x', 1 FROM r WHERE ok)
SELECT item_id, kind, plan_pos::BIGINT AS plan_pos, query_text, priority::BIGINT AS priority FROM p"""),
    "fallback_keywords": (fallback_keywords, f"""
SELECT {_ITEM} AS item_id, coalesce(array_to_string(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{4,}}'), lambda z: NOT list_contains({sql_list(lex.QUERY_STOP_WORDS)}, z))[1:3], '|'), '') AS must_include_keywords,
  4::BIGINT AS queries FROM conversations"""),
    "two_pass": (two_pass, f"""
WITH r AS (SELECT {_ITEM} AS item_id, {_OK} AS ok, turn % 4 AS c, ({_ITEM}) % 4 AS p, conv_id % 2 = 0 AS d FROM conversations), u AS (SELECT *, ok AND p <> c AND d AS unclear FROM r)
SELECT item_id, CASE WHEN unclear THEN 'ambiguous' ELSE 'clear' END AS status, CASE WHEN ok THEN p END AS selected_index,
  CASE WHEN unclear THEN c || '|' || p ELSE c::VARCHAR END AS defensible_options, CASE WHEN unclear THEN 0.1 WHEN ok THEN 0.9 ELSE 0 END::DOUBLE AS confidence FROM u"""),
    "all_options": (all_options, f"""
WITH r AS (SELECT {_ITEM} AS item_id, {_OK} AS ok, turn % 4 AS c, conv_id % 3 = 0 AS amb FROM conversations),
o AS (SELECT *, list_filter([0, 1, 2, 3], lambda i: item_id % (i + 3) = 0 AND i <> c) AS x FROM r)
SELECT item_id, CASE WHEN NOT ok THEN 'invalid' WHEN len(x) > 0 OR amb THEN 'ambiguous' ELSE 'clear' END AS status,
  CASE WHEN ok THEN array_to_string(list_concat([c], x), '|') END AS defensible_options, CASE WHEN NOT ok THEN 0 WHEN len(x) > 0 OR amb THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM o"""),
    "review_replies": (review_replies, f"""
WITH r AS (SELECT {_ITEM} AS item_id, {_OK} AS ok, turn, conv_id FROM conversations)
SELECT item_id, CASE WHEN ok AND turn % 2 = 0 THEN 'major' ELSE 'minor' END AS severity, CASE WHEN ok THEN 'CLARITY' ELSE 'quality_check_error' END AS rule_name,
  CASE WHEN NOT ok THEN 'Quality check failed' WHEN turn % 3 = 0 THEN 'unclear' ELSE 'Quality issue found' END AS description FROM r WHERE NOT ok OR turn > 0
UNION ALL SELECT item_id, CASE WHEN ok THEN 'major' ELSE 'minor' END, CASE WHEN ok THEN 'answer_grounded' ELSE 'grounding_check_error' END,
  CASE WHEN ok THEN 'Answer not found in source material' ELSE 'Grounding check failed' END FROM r WHERE turn % 4 > 0 AND (NOT ok OR conv_id % 2 = 1)"""),
    "anchored_ingest": (anchored_ingest, f"""
WITH {SQL_TURNS} SELECT item_id, coalesce((s[2:5])[CASE WHEN item_id % 2 = 0 THEN 2 ELSE 1 END], '') AS correct_answer FROM turns WHERE item_id % 5 > 0"""),
    "exam_flatten": (exam_flatten, f"""
WITH r AS (SELECT {_ITEM} AS n FROM conversations WHERE {_OK}), w AS (SELECT *, CASE WHEN n % 4 = 0 THEN '15.5' WHEN n % 2 = 0 AND n % 3 > 0 THEN '15.0' ELSE 'none' END AS w FROM r)
SELECT 'Exam ' || n AS certification_name, CASE WHEN n % 3 = 0 THEN 70 ELSE 99 END::BIGINT AS num_questions, 45::BIGINT AS time_limit_minutes, 'online|center|site' AS delivery_methods,
  w || '|' || w AS weights, CASE WHEN n % 5 > 0 THEN 'The mcq|The mcq' ELSE 'mcq|mcq' END AS types FROM w"""),
    "exam_text": (exam_text, f"""
SELECT 'Exam ' || ({_ITEM}) AS certification_name, 15::BIGINT AS lines, 'Questions: ' || CASE WHEN ({_ITEM}) % 3 = 0 THEN '70' ELSE '?' END AS second_line FROM conversations WHERE {_OK}"""),
    "flat_exam": (flat_exam, f"SELECT ({_ITEM})::VARCHAR AS certification_name, 10::BIGINT AS num_questions, 'MCQ|' || role AS types, turn::DOUBLE AS weight FROM conversations"),
    "weight_repair": (weight_repair, f"""
SELECT {_ITEM} AS item_id, CASE ({_ITEM}) % 4 WHEN 0 THEN 25 WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN turn % 2 = 0 THEN 12 ELSE 15 END ELSE 30 END::DOUBLE AS weight FROM conversations"""),
    "question_parse": (question_parse, f"""
WITH {SQL_TURNS}
SELECT item_id, CASE WHEN turn % 2 = 0 THEN 'multiple_choice' ELSE 'multiple_response' END AS question_type, CASE WHEN turn % 2 = 0 THEN len(s) ELSE -1 END::BIGINT AS single_choices,
  CASE WHEN turn % 2 = 0 THEN 'B' ELSE '' END AS label, CASE WHEN turn % 2 = 0 THEN '' ELSE 'A,B' END AS labels, 'second|' || role AS sources FROM turns WHERE item_id % 5 > 0"""),
    "stage_counts": (stage_counts, f"""
WITH r AS (SELECT {_OK} AS ok, turn % 3 AS k FROM conversations)
SELECT 'total' AS measure, count(*) AS n FROM r UNION ALL SELECT 'succeeded', count(*) FILTER (ok) FROM r UNION ALL SELECT 'failed', count(*) FILTER (NOT ok) FROM r
UNION ALL SELECT 'multiple_choice', count(*) FILTER (ok AND k = 0) FROM r UNION ALL SELECT 'ordering', count(*) FILTER (ok AND k = 1) FROM r
UNION ALL SELECT 'other', count(*) FILTER (NOT ok OR k = 2) FROM r
UNION ALL SELECT unnest({sql_list([k for k in Qn.PAYLOADS if k not in ("multiple_choice", "ordering")])}), 0"""),
    "type_registry": (type_registry, """
WITH k AS (SELECT DISTINCT replace(p_name, ' ', '_') AS question_type FROM part), n AS (SELECT question_type FROM k UNION SELECT lower(replace(p_type, ' ', '_')) FROM part)
SELECT question_type, CASE WHEN question_type IN (SELECT question_type FROM k) THEN 'all_or_nothing' ELSE 'manual' END AS scoring FROM n"""),
    "content_requests": (content_requests, f"""
WITH {SQL_SOURCE_ITEMS}, {SQL_LINKS},
c AS (SELECT item_id, string_agg('[Source: ' || source || ', p.' || (chunk_id % 9) || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_pos) AS c FROM links WHERE chunk_pos < 5 GROUP BY 1),
r AS (SELECT item_id, concat_ws(chr(10), 'Learning target: ' || learning_target, 'Difficulty: ' || difficulty, 'Sources:', c, 'Images:' || chr(10) || 'No images available') AS r FROM source_items JOIN c USING (item_id))
SELECT item_id, md5(r) AS digest, length(r) // 4 AS tokens FROM r"""),
    "anchored_requests": (anchored_requests, f"""
WITH {SQL_TURNS},
r AS (SELECT item_id, concat_ws(chr(10), 'Learning target: ' || role, 'Anchors:' || chr(10) || array_to_string(list_transform(s, lambda z, i: 'ANCHOR ' || i || ' (p.1, 2):' || chr(10) || '"' || z || '"'), chr(10) || chr(10)),
  'Evidence:' || chr(10) || '[Source: p.N/A]' || chr(10) || text[1:500], 'Distractors: {Req.DIFFICULTY_GUIDES["advanced"]}') AS r FROM turns WHERE len(s) > 0)
SELECT item_id, md5(r) AS digest, length(r) // 4 AS tokens FROM r"""),
    "query_requests": (query_requests, f"""
WITH r AS (SELECT {_ITEM} AS item_id, concat_ws(chr(10), 'Topic: T', 'Subtopic: ' || role, 'Learning target: ' || text, 'Sections:' || chr(10) ||
  CASE WHEN turn > 0 AND len({sql_words('text')}) > 0 THEN array_to_string(list_transform({sql_words('text')}[1:10], lambda z: '- ' || z), chr(10)) ELSE '(No section information available)' END) AS r FROM conversations)
SELECT item_id, md5(r) AS digest, length(r) // 4 AS tokens FROM r"""),
    "quote_blocks": (quote_blocks, f"""
WITH {SQL_TURNS}
SELECT item_id, md5(CASE WHEN turn = 0 OR len(s) = 0 THEN '(No anchor quotes extracted)' ELSE array_to_string(list_transform(s[1:4], lambda z, i: '[Q' || i || '] (p.' || (i - 1) || ')' || CASE WHEN i % 2 = 1 THEN ' [' || role || ']' ELSE '' END || ':' || chr(10) || '"' || z || '"'), chr(10) || chr(10)) END) AS digest,
  md5(coalesce(array_to_string(list_transform(s, lambda z, i: chr((64 + i)::INT) || '. ' || z), chr(10)), '')) AS letters,
  md5(coalesce(array_to_string(list_transform(s, lambda z, i: (i - 1) || ') ' || z), chr(10)), '')) AS numbers FROM turns"""),
}
