"""A title's copies are folded before wanted books meet them."""

from lectern.operators import catalogue


def test_many_copies_of_a_title_meet_its_authors_once(spark):
    wanted = spark.createDataFrame([(1, "a", "ann"), (2, "a", "bob"), (3, "a", None), (4, "b", "ann"), (5, "a", "eve")], "book_id long, title string, author string")
    rows = [("a", 10 + i, 100 + i, ("by Ann", "by Bob", None)[i % 3]) for i in range(300)]
    hits = spark.createDataFrame(rows[::-1], "title string, hit_pos long, hit_id long, hit_author string")
    out = catalogue.match_books(wanted, hits)
    got = {r.book_id: (r.hit_id, r.hit_author, r.found) for r in out.collect()}
    assert got == {1: (100, "by Ann", True), 2: (101, "by Bob", True), 3: (100, "by Ann", True), 4: (None, None, False), 5: (100, "by Ann", True)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Inner"):]
    assert "min_by" in below and "hit_author" in below[below.index("min_by"):]
