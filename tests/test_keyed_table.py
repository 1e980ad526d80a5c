"""Upserts into a stored table: last write wins against the stored row."""

import os

from affinis.sources.manifest import KeyedTable

SCHEMA = "id long, seq long, note string"


def _rows(df):
    return {tuple(r) for r in df.collect()}


def _frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def _files(root, manifest):
    found = {}
    for b, part in manifest["at"].items():
        folder = os.path.join(root, "data", part, f"bucket={b}")
        found[b] = {(n, os.stat(os.path.join(folder, n)).st_mtime_ns) for n in os.listdir(folder)}
    return found


def test_repeated_ids_late_rows_and_nulls(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), SCHEMA, ["id"], ["seq"], buckets=4)
    assert t.read().count() == 0
    t.merge(_frame(spark, (1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (None, 1, "n"), (2, None, None)))
    assert _rows(t.read()) == {(1, 3, "c"), (None, 1, "n"), (2, None, None)}
    m = t.merge(_frame(spark, (1, 2, "late"), (None, 2, "n2"), (2, 0, "z"), (3, 1, "a"), (3, 1, "b")))
    assert _rows(t.read()) == {(1, 3, "c"), (None, 2, "n2"), (2, 0, "z"), (3, 1, "b")}
    assert t.merge(_frame(spark)) == m and t.files.names("work") == []


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), SCHEMA, ["id"], ["seq"], buckets=8)
    first = t.merge(spark.range(200).selectExpr("id", "0L as seq", "'old' as note"))
    before = _files(str(tmp_path), first)
    after = t.merge(_frame(spark, (7, 1, "new")))
    moved = [b for b in before if first["at"][b] != after["at"][b]]
    assert len(before) == 8 and len(moved) == 1
    now = _files(str(tmp_path), after)
    assert all(now[b] == before[b] for b in before if b not in moved)
    assert t.read().count() == 200 and t.read().where("note = 'new'").collect()[0].id == 7
    assert t.read(first["version"]).where("note = 'new'").count() == 0  # the earlier manifest reads on


def test_two_writers_on_one_bucket_lose_nothing(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path), SCHEMA, ["id"], ["seq"], buckets=1)
    other = KeyedTable(spark, str(tmp_path), SCHEMA, ["id"], ["seq"])
    inner, once = t.log.commit, []

    def late(change):
        if not once:
            once.append(other.merge(_frame(spark, (2, 9, "other"), (1, 0, "older"))))
        return inner(change)

    monkeypatch.setattr(t.log, "commit", late)
    t.merge(_frame(spark, (1, 5, "mine"), (2, 1, "mine")))
    assert _rows(t.read()) == {(1, 5, "mine"), (2, 9, "other")}
