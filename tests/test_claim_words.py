"""Words of claims and of a chunk's parts are split once, not for each pair of them."""

from lectern.operators import claims as C


def test_words_are_split_before_claims_meet_parts(spark):
    told = spark.createDataFrame([(1, 0, "Red fish swim here."), (1, 1, "Nothing alike at all.")], "item_id long, claim_pos int, claim string")
    links = spark.createDataFrame([(1, 7, 0, "Blue birds sing. Red fish swim there. End.")], "item_id long, chunk_id long, chunk_pos int, text string")
    out = C.match_claims(told, links, 0.3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    met = [line for line in plan.splitlines() if "Generate" in line and "arrays" not in line]
    assert met and not any("split(" in line for line in met)
    got = {r.claim_pos: r.matched_text for r in out.collect()}
    assert got[0].startswith("red fish swim there") and not got[1]
