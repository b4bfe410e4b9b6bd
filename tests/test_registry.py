"""A few registered queries against their SQL twins; ``python -m catalog.check`` runs them all."""

import pytest

import __spark_entry__ as entry
from catalog.check import compare, connect

NAMES = ["quotable_top3", "chunk_pages", "vector_topk", "claim_match", "gate_report", "novelty_check", "greedy_dedup", "funnel_flat", "mastery", "plan_issues", "review_sessions"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, name):
    line = compare(spark, connect(sf), sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert line.endswith("ok"), line


def test_every_query_is_registered_once():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120
