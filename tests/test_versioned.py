"""Tables that are never half written."""

import pytest

from lectern.sources import store
from lectern.sources.versioned import ConcurrentWrite, VersionedTable

ROWS = "name string, number long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def content(df):
    return sorted((tuple(r) for r in df.select("name", "number", "text").collect()), key=repr)


def test_upserts_make_versions_and_touch_few_buckets(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["name", "number"], buckets=16)
    first = [("a", i, f"x{i}") for i in range(40)] + [(None, 1, "null"), (None, None, "both"), ("a b/c=d", 7, "odd name")]
    assert table.manifest() is None and table.upsert(frame(spark, first)) == 1
    assert table.upsert(frame(spark, [("a", 3, "new"), (None, 1, "also new"), ("b", 1, "z"), ("b", 1, "y")])) == 2
    want = {(n, k): t for n, k, t in first} | {("a", 3): "new", (None, 1): "also new", ("b", 1): "y"}
    assert content(table.read()) == sorted(((n, k, t) for (n, k), t in want.items()), key=repr)
    assert content(table.read(1)) == sorted(first, key=repr)
    old, new = table.manifest(1)["folders"], table.manifest(2)["folders"]
    assert sum(old.get(b) != f for b, f in new.items()) <= 3
    assert table.upsert(frame(spark, []).limit(0)) is None and table.versions() == [1, 2]
    assert len(table.vacuum(keep=2)) == 0 and table.versions() == [1, 2]
    table.vacuum()
    assert table.versions() == [2] and table.read().count() == len(want)
    with pytest.raises(ValueError):
        table.read(1)
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path / "none"), ["name"]).read()


def test_a_killed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), ["name", "number"], buckets=4)
    table.upsert(frame(spark, [("a", 1, "x"), ("b", 2, "y")]))

    def killed(manifest):
        raise KeyboardInterrupt

    monkeypatch.setattr(table, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(frame(spark, [("a", 1, "half"), ("c", 3, "half")]))
    again = VersionedTable(spark, str(tmp_path / "t"), ["name", "number"])
    assert content(again.read()) == [("a", 1, "x"), ("b", 2, "y")] and again.versions() == [1]
    again.upsert(frame(spark, [("a", 1, "whole"), ("c", 3, "whole")]))
    assert content(again.read()) == [("a", 1, "whole"), ("b", 2, "y"), ("c", 3, "whole")]
    assert len(again.vacuum()) >= 1 and content(again.read())[0] == ("a", 1, "whole")


def test_of_two_writes_from_one_version_the_second_fails(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), ["name", "number"], buckets=4)
    table.upsert(frame(spark, [("a", 1, "x")]))
    late, start = VersionedTable(spark, str(tmp_path / "t"), ["name", "number"]), table.manifest()
    table.upsert(frame(spark, [("a", 1, "first")]))
    monkeypatch.setattr(late, "manifest", lambda version=None: start)
    with pytest.raises(ConcurrentWrite):
        late.upsert(frame(spark, [("a", 1, "second")]))
    assert content(table.read()) == [("a", 1, "first")] and table.versions() == [1, 2]


def test_replaced_groups_go_whole(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["name", "number"], buckets=8)
    table.upsert(frame(spark, [("a", i, "x") for i in range(9)] + [("b", 1, "y"), (None, 1, "n")]))
    gone = spark.createDataFrame([("a",), (None,)], "name string")
    assert table.replace(frame(spark, [("a", 100, "only")]), gone) == 2
    assert content(table.read()) == [("a", 100, "only"), ("b", 1, "y")]
    assert table.replace(frame(spark, []).limit(0), gone) == 3
    assert content(table.read()) == [("b", 1, "y")]


def test_columns_may_be_added(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["name"], buckets=2)
    table.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "name string, number long"))
    table.upsert(spark.createDataFrame([("b", "new")], "name string, text string"))
    assert content(table.read().filter("number is not null")) == [("a", 1, None)]
    assert [r.text for r in table.read().filter("name = 'b'").collect()] == ["new"]


def test_latest_copy_follows_versions(spark, tmp_path):
    path, make = str(tmp_path / "v"), lambda rows: spark.createDataFrame(rows, "course_id string, version int, title string")
    store.write_version(make([("c1", 2, "two"), ("c1", 1, "one"), ("c2", 1, "other")]), path)
    store.write_version(make([("c1", 1, "one, mended")]), path)
    assert sorted(r.title for r in store.latest(spark, path).collect()) == ["other", "two"]
    assert sorted(r.title for r in store.version_of(spark, path, 1).collect()) == ["one, mended", "other"]
    store.write_version(make([("c1", 3, "three")]), path)
    assert sorted(r.title for r in store.latest(spark, path).collect()) == ["other", "three"]
