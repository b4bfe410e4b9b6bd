"""A text is moved and checked once for all quotes of its item."""

from lectern.operators import quotes


def test_a_text_meets_all_its_quotes_on_one_row(spark):
    texts = spark.createDataFrame(
        [(1, "The crew should wait. Then they shovld go on to the next house.", ["Q1", "Q1", "Q2", "Q9", "Q9"]), (2, None, None), (3, "Nothing.", None), (4, "Wait", [])],
        "item_id long, generated_text string, required_quote_ids array<string>",
    )
    given = spark.createDataFrame(
        [(1, "Q1", "The crew should wait."), (1, "Q2", "then they should go on to the next house"), (1, "Q3", "not asked for"), (2, "Q1", "lost"), (2, "Q2", None), (4, "Q1", "Wait")],
        "item_id long, quote_id string, text string",
    )
    want = {1: (5, 2, 1, ["Q9", "Q9"]), 2: (2, 0, 0, ["Q1", "Q2"]), 3: (0, 0, 0, []), 4: (0, 0, 0, [])}
    for fuzzy in (True, False):
        out = quotes.verify_quotes(texts, given, fuzzy=fuzzy)
        got = {r.item_id: (r.required_count, r.exact_match_count, r.fuzzy_match_count, r.missing_quote_ids) for r in out.collect()}
        assert got == (want if fuzzy else {**want, 1: (5, 2, 0, ["Q2", "Q9", "Q9"])})
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # no grouping above the join: rows of quotes with their text and all ids were sorted for it, and spilled
        assert plan.index("Join") < plan.index("Aggregate")
