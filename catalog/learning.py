"""Queries over learner events: answers, scores, sessions, mastery, votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import plain, table
from lectern.functions import text as T
from lectern.operators import ambiguity as B
from lectern.operators import learner as L
from lectern.streaming.jobs import pass_rates

def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _reviews(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select(
        F.col("user_id").alias("learner_id"), (F.col("k") % 10).alias("item_id"), "event_id", "ts", (F.col("event_type") != "error").alias("is_correct"),
        (F.col("event_id") % 5 + 1).alias("confidence"), F.col("value").alias("seconds"),
    )


SQL_EVENTS = "e AS (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)"
SQL_REVIEWS = f"""{SQL_EVENTS},
r AS (SELECT user_id AS learner_id, k % 10 AS item_id, event_id, ts, event_type <> 'error' AS ok, event_id % 5 + 1 AS confidence, value AS seconds FROM e)"""


def _answered(spark, sf_dir):
    """Each event answers a question with options a to e; two of them are right in half of the questions."""
    e = _events(spark, sf_dir)
    letters = T.words_array("a b c d e".split())
    several = F.col("k") % 2 == 0
    selected = F.when(F.col("event_type") == "signup", T.words_array([])).when(F.col("event_type") == "view", F.array(F.element_at(letters, (F.col("k") % 5 + 1).cast("int")))).otherwise(
        F.array(F.element_at(letters, (F.col("event_id") % 5 + 1).cast("int")), F.element_at(letters, (F.col("event_id") % 3 + 1).cast("int")))
    )
    correct = F.when(several, F.array(F.element_at(letters, (F.col("k") % 5 + 1).cast("int")), F.lit("b"))).otherwise(F.array(F.element_at(letters, (F.col("k") % 5 + 1).cast("int"))))
    chosen = L.capped_selection(F.array_distinct(selected), F.size(F.array_distinct(correct)))
    return e.select("event_id", F.col("user_id").alias("learner_id"), F.col("k").alias("capsule_id"), "ts", "value", L.answer_status(chosen, F.array_distinct(correct), several).alias("status"))


SQL_ANSWERED = f"""{SQL_EVENTS},
p AS (SELECT *, ['a', 'b', 'c', 'd', 'e'] AS l, k % 2 = 0 AS several FROM e),
q AS (SELECT *, CASE event_type WHEN 'signup' THEN [] WHEN 'view' THEN [l[(k % 5 + 1)::INT]] ELSE
        CASE WHEN event_id % 5 = event_id % 3 THEN [l[(event_id % 5 + 1)::INT]] ELSE [l[(event_id % 5 + 1)::INT], l[(event_id % 3 + 1)::INT]] END END AS s0,
      CASE WHEN several AND k % 5 <> 1 THEN [l[(k % 5 + 1)::INT], 'b'] ELSE [l[(k % 5 + 1)::INT]] END AS c FROM p),
a AS (SELECT event_id, user_id AS learner_id, k AS capsule_id, ts, value, c, several, s0[1:len(c)] AS s FROM q),
answered AS (
  SELECT *, CASE WHEN len(s) = 0 THEN 'unanswered'
    WHEN several THEN CASE WHEN len(s) = len(c) AND len(list_intersect(s, c)) = len(c) THEN 'correct' WHEN len(list_intersect(s, c)) > 0 THEN 'partially_correct' ELSE 'incorrect' END
    WHEN len(s) = 1 AND s[1] = c[1] THEN 'correct' ELSE 'incorrect' END AS status FROM a)"""


def answer_statuses(spark, sf_dir):
    return plain(_answered(spark, sf_dir).select("event_id", "status"))


def capsule_scores(spark, sf_dir):
    return plain(L.capsule_score(_answered(spark, sf_dir), ["learner_id", "capsule_id"]))


def attempts(spark, sf_dir):
    rows = _answered(spark, sf_dir)
    scores = L.capsule_score(rows, ["learner_id", "capsule_id"])
    times = rows.select("learner_id", "capsule_id", "ts", F.floor("value").alias("seconds"))
    return plain(L.attempts(scores.select("learner_id", "capsule_id", "percentage"), times).select("learner_id", "capsule_id", "percentage", "time_spent", "completed_at", "is_completed"))


def _capsules(spark, sf_dir):
    """Every user is a lab with capsules 0 to 99; completed where the best value reaches 60."""
    e = _events(spark, sf_dir)
    return e.groupBy(F.col("user_id").alias("lab_id"), F.col("k").alias("capsule_pos")).agg(F.max("value").alias("v"), F.sum(F.floor("value")).alias("time_spent")).select(
        "lab_id", "capsule_pos", F.concat(F.lit("cap_"), F.col("capsule_pos").cast("string")).alias("capsule_id"), (F.col("v") >= 30).alias("is_completed"),
        F.least(F.floor("v"), F.lit(100)).alias("score"), "time_spent",
    )


SQL_CAPSULES = f"""{SQL_EVENTS},
c AS (SELECT user_id AS lab_id, k AS capsule_pos, 'cap_' || k AS capsule_id, max(value) >= 30 AS done, least(floor(max(value)), 100)::BIGINT AS score, sum(floor(value))::BIGINT AS t FROM e GROUP BY 1, 2)"""


def lab_summary(spark, sf_dir):
    return plain(L.lab_summary(_capsules(spark, sf_dir)))


def section_progress(spark, sf_dir):
    nodes = _capsules(spark, sf_dir).select(F.col("lab_id").alias("section_id"), F.when(F.col("is_completed"), "completed").otherwise("available").alias("status"))
    return plain(L.section_progress(nodes))


def next_capsule(spark, sf_dir):
    return plain(L.next_incomplete(_capsules(spark, sf_dir)))


def review_correct(spark, sf_dir):
    e = _events(spark, sf_dir)
    reviews = e.select("event_id", F.col("k").alias("question_id"), (F.col("event_id") % 4).alias("option_id"), F.col("value").alias("seconds"))
    options = e.select(F.col("k").alias("question_id")).distinct().select("question_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("option_id"))
    marked = options.withColumn("is_correct", F.col("option_id") == F.col("question_id") % 4)
    return plain(L.review_events(reviews, marked).select("event_id", "question_id", "is_correct"))


def review_sessions(spark, sf_dir):
    return plain(L.review_sessions(_reviews(spark, sf_dir), gap_seconds=36 * 3600, bucket_seconds=7 * 86400))


def mastery(spark, sf_dir):
    return plain(L.mastery(_reviews(spark, sf_dir), order=["ts", "event_id"]))


def priority_flags(spark, sf_dir):
    r = _reviews(spark, sf_dir)
    return plain(r.groupBy(F.coalesce(L.priority_flag("is_correct", "confidence"), F.lit("none")).alias("flag")).agg(F.count(F.lit(1)).alias("reviews"), F.max(L.capped_interval(F.col("event_id") % 400)).alias("longest")))


def due_session(spark, sf_dir):
    due = L.mastery(_reviews(spark, sf_dir), order=["ts", "event_id"]).filter("not is_mastered")
    return plain(L.due_session(due, ["streak", "learner_id", "item_id"], size=80).select("learner_id", "item_id", "streak"))


def vote_consensus(spark, sf_dir):
    votes = _events(spark, sf_dir).select(F.col("k").alias("item_id"), F.col("event_type").alias("option"))
    a = B.vote_consensus(votes).select("item_id", "total_votes", "top_votes", "consensus", "confidence", "passes")
    b = B.vote_share(votes, 0.25).select("item_id", F.col("confidence").alias("share"), F.col("passes").alias("share_passes"))
    return plain(a.join(b, "item_id"))


def hourly_pass_rates(spark, sf_dir):
    scores = _events(spark, sf_dir).select("ts", F.col("value").alias("score"))
    return plain(pass_rates(scores, "1 hour"))


def sliding_pass_rates(spark, sf_dir):
    scores = _events(spark, sf_dir).select("ts", F.col("value").alias("score"))
    return plain(pass_rates(scores, "1 hour", "15 minutes"))


QUERIES = {
    "answer_statuses": (answer_statuses, f"WITH {SQL_ANSWERED} SELECT event_id, status FROM answered"),
    "capsule_scores": (capsule_scores, f"""
WITH {SQL_ANSWERED}, s AS (SELECT learner_id, capsule_id, sum(CASE status WHEN 'correct' THEN 1.0 WHEN 'partially_correct' THEN 0.5 ELSE 0 END) AS points,
  count(*) FILTER (status = 'partially_correct') AS partially_correct, count(*) AS total FROM answered GROUP BY 1, 2)
SELECT learner_id, capsule_id, floor(points)::BIGINT AS correct, partially_correct, total, floor(points / total * 100 + 0.5)::BIGINT AS percentage FROM s"""),
    "attempts": (attempts, f"""
WITH {SQL_ANSWERED}, s AS (SELECT learner_id, capsule_id, sum(CASE status WHEN 'correct' THEN 1.0 WHEN 'partially_correct' THEN 0.5 ELSE 0 END) AS points, count(*) AS total,
  sum(floor(value))::BIGINT AS time_spent, max(ts) AS completed_at FROM answered GROUP BY 1, 2)
SELECT learner_id, capsule_id, floor(points / total * 100 + 0.5)::BIGINT AS percentage, time_spent, completed_at, true AS is_completed FROM s"""),
    "lab_summary": (lab_summary, f"""
WITH {SQL_CAPSULES}, s AS (SELECT lab_id, count(*) AS capsules, count(*) FILTER (done) AS completed, coalesce(sum(t) FILTER (done), 0)::BIGINT AS total_time, count(*) FILTER (done AND score >= 90) AS excellent,
  count(*) FILTER (done AND score >= 80 AND score < 90) AS good, count(*) FILTER (done AND score >= 70 AND score < 80) AS fair, count(*) FILTER (done AND score < 70) AS needs_improvement,
  coalesce(sum(score) FILTER (done), 0) AS sc FROM c GROUP BY 1)
SELECT lab_id, capsules, completed, total_time, excellent, good, fair, needs_improvement, round(completed / capsules * 100, 6) AS progress,
  CASE WHEN completed > 0 THEN floor(sc / completed + 0.5) ELSE 0 END::BIGINT AS average_score, CASE WHEN completed > 0 THEN floor((excellent + good + fair) / completed * 100 + 0.5) ELSE 0 END::BIGINT AS success_rate FROM s"""),
    "section_progress": (section_progress, f"WITH {SQL_CAPSULES} SELECT lab_id AS section_id, count(*) AS nodes, count(*) FILTER (done) AS completed, round(count(*) FILTER (done) / count(*) * 100, 6) AS progress FROM c GROUP BY 1"),
    "next_capsule": (next_capsule, f"WITH {SQL_CAPSULES} SELECT lab_id, arg_min(capsule_id, capsule_pos) FILTER (NOT done) AS next_capsule_id FROM c GROUP BY 1"),
    "review_correct": (review_correct, f"WITH {SQL_EVENTS} SELECT event_id, k AS question_id, event_id % 4 = k % 4 AS is_correct FROM e"),
    "review_sessions": (review_sessions, f"""
WITH {SQL_REVIEWS},
g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY learner_id ORDER BY ts) < 36 * 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT *, sum(new) OVER (PARTITION BY learner_id ORDER BY ts) AS session_no FROM g)
SELECT learner_id, session_no::BIGINT AS session_no, min(ts) AS session_start, max(ts) AS session_end, count(*) AS items, count(*) FILTER (ok) AS correct, round(sum(seconds), 6) AS total_time,
  floor(count(*) FILTER (ok) / count(*) * 100 + 0.5)::BIGINT AS accuracy_rate, round(avg(confidence), 6) AS average_confidence FROM n GROUP BY 1, 2"""),
    "mastery": (mastery, f"""
WITH {SQL_REVIEWS},
o AS (SELECT *, row_number() OVER (PARTITION BY learner_id, item_id ORDER BY ts DESC, event_id DESC) AS rn FROM r),
s AS (SELECT learner_id, item_id, count(*) AS reviews, arg_max(confidence, -rn) AS last_confidence, coalesce(min(rn) FILTER (NOT ok) - 1, count(*)) AS streak,
  count(*) FILTER (ok AND rn <= 10) / count(*) FILTER (rn <= 10) AS strength FROM o GROUP BY 1, 2)
SELECT learner_id, item_id, reviews, last_confidence, streak, round(strength, 6) AS strength, strength >= 0.9 AND streak >= 3 AND last_confidence >= 4 AS is_mastered FROM s"""),
    "priority_flags": (priority_flags, f"""
WITH {SQL_REVIEWS} SELECT CASE WHEN NOT ok AND confidence >= 4 THEN 'priority' WHEN NOT ok THEN 'reset' ELSE 'none' END AS flag, count(*) AS reviews, max(least(event_id % 400, 180)) AS longest FROM r GROUP BY 1"""),
    "due_session": (due_session, f"""
WITH {SQL_REVIEWS},
o AS (SELECT *, row_number() OVER (PARTITION BY learner_id, item_id ORDER BY ts DESC, event_id DESC) AS rn FROM r),
s AS (SELECT learner_id, item_id, arg_max(confidence, -rn) AS conf, coalesce(min(rn) FILTER (NOT ok) - 1, count(*)) AS streak, count(*) FILTER (ok AND rn <= 10) / count(*) FILTER (rn <= 10) AS strength FROM o GROUP BY 1, 2)
SELECT learner_id, item_id, streak FROM s WHERE NOT (strength >= 0.9 AND streak >= 3 AND conf >= 4) ORDER BY streak, learner_id, item_id LIMIT 50"""),
    "vote_consensus": (vote_consensus, f"""
WITH {SQL_EVENTS}, v AS (SELECT k AS item_id, event_type AS option, count(*) AS n FROM e GROUP BY 1, 2),
t AS (SELECT item_id, sum(n)::BIGINT AS total_votes, max(n) AS top_votes FROM v GROUP BY 1)
SELECT t.*, (SELECT min(option) FROM v WHERE v.item_id = t.item_id AND v.n = t.top_votes) AS consensus, round(top_votes / 10, 6) AS confidence, top_votes >= 9 AS passes,
  round(top_votes / total_votes, 6) AS share, top_votes / total_votes >= 0.25 AS share_passes FROM t"""),
    "hourly_pass_rates": (hourly_pass_rates, """
SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS attempts, count(*) FILTER (value >= 70) AS passed, round(count(*) FILTER (value >= 70) / count(*), 4) AS pass_rate FROM events GROUP BY 1"""),
    "sliding_pass_rates": (sliding_pass_rates, """
WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) AS window_start, value FROM events, unnest(range(4)) AS u(i))
SELECT window_start, count(*) AS attempts, count(*) FILTER (value >= 70) AS passed, round(count(*) FILTER (value >= 70) / count(*), 4) AS pass_rate FROM w GROUP BY 1"""),
}
