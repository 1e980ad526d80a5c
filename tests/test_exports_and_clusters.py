"""Paged cluster lists, export by user, and line numbers of split files."""

import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from affinis.operators import clusters
from affinis.params import Params
from affinis.plans import queries as q
from affinis.plans.batch import run_batch
from affinis.sources import files, tables, user_files
from tests.conftest import SF001


def _folder(name):
    return tempfile.mkdtemp(prefix=f"affinis-{name}-")


# ------------------------------------------------------------------ file order

@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_of_split_files_fill_forward_as_read_in_sequence(spark, tiny_splits):
    d = _folder("lines")
    want, paths = [], []
    for f, n in enumerate([900, 3, 400]):
        path, last = os.path.join(d, f"f{f}.csv"), None
        paths.append(path)
        with open(path, "w") as out:
            out.write('"id";"categ"\n')
            for i in range(n):
                # the ids grow and fall, so that only the order of lines gives the right one
                id_ = f"x_{(i * 7919) % 1000}" if i % 37 == 5 else ""
                out.write(f'"{id_}";"c{i}"\n')
                last = id_ or last
                want.append((f"f{f}.csv", i, f"c{i}", last))
        if f == 1:
            with open(path, "a") as out:
                out.write("\n")  # a blank line is no row
    read = files.read_erp_csv(spark, paths, files.ERP_PRODUCTS_SCHEMA)
    got = files.forward_fill(read, "id", ["_file"], "_line", bucket=64).select(
        F.substring_index("_file", "/", -1), "_line", "category", F.nullif("id", F.lit(""))).collect()
    assert spark.read.text(paths).rdd.getNumPartitions() > 8
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_lines(spark):
    path = os.path.join(_folder("lines"), "f.csv")
    with open(path, "w") as out:
        out.write('"id";"categ"\n')
    assert files.read_erp_csv(spark, [path], files.ERP_PRODUCTS_SCHEMA).count() == 0


# -------------------------------------------------------------- export by user

def _rows(n_users, hot):
    rows = [(u, i, float(u + i) / 2) for u in range(n_users) for i in range(3)]
    return rows + [(9999, i, 1.0) for i in range(hot)] + [(None, 1, 2.0)]


def test_files_do_not_follow_users_and_a_hot_user_spans_several(spark):
    schema = "userid int, itemid int, prediction double"
    counts = []
    for n_users in (50, 800):
        path = _folder("export")
        df = spark.createDataFrame(_rows(n_users, 1500), schema)
        user_files.write_user_files(df, path, files=6)
        written = [f for _, _, fs in os.walk(os.path.join(path, "data")) for f in fs if f.endswith(".csv")]
        counts.append(len(written))
        index = spark.read.parquet(os.path.join(path, "index")).collect()
        assert sum(r.n_rows for r in index) == n_users * 3 + 1500
        assert {r.userid for r in index} == {*range(n_users), 9999}
        assert len([r for r in index if r.userid == 9999]) > 1
    assert max(counts) <= 6


def test_index_names_the_rows_of_a_user(spark):
    path = _folder("export")
    df = spark.createDataFrame(_rows(40, 70), "userid int, itemid int, prediction double")
    user_files.write_user_files(df, path, files=4)
    parts = {}
    for root, _, names in os.walk(os.path.join(path, "data")):
        for n in names:
            if n.endswith(".csv"):
                part = int(root.rsplit("part=", 1)[1])
                assert part not in parts  # one file a part
                parts[part] = open(os.path.join(root, n)).read().splitlines()[1:]
    for r in spark.read.parquet(os.path.join(path, "index")).collect():
        lines = parts[r.part][r.first_row:r.first_row + r.n_rows]
        assert {int(x.split(",")[0]) for x in lines} == {r.userid}
    got = user_files.read_user_files(spark, path, spark.createDataFrame([(3,), (3,), (9999,), (-1,)], "userid int"),
                                     "itemid int, prediction double")
    assert got.columns == ["userid", "itemid", "prediction"]
    assert sorted(map(tuple, got.collect())) == sorted(t for t in _rows(40, 70) if t[0] in (3, 9999))


def test_only_the_parts_named_are_scanned(spark):
    path = _folder("export")
    user_files.write_user_files(spark.createDataFrame(_rows(400, 0), "userid int, itemid int, prediction double"),
                                path, files=8)
    got = user_files.read_user_files(spark, path, spark.createDataFrame([(1,)], "userid int"),
                                     "itemid int, prediction double")
    assert len({f for r in got.select(F.input_file_name()).collect() for f in r}) == 1
    assert re.search(r"PartitionFilters: \[[^\]]*part#", got._jdf.queryExecution().toString())


def test_libsvm_lines_and_taken_names(spark):
    df = spark.createDataFrame([(1, 4.0, [0.0, 2.5, 1.0]), (2, 3.0, [0.0, 0.0, 0.0])],
                               "userid int, rating double, features array<double>")
    got = df.select("userid", user_files.libsvm_line("rating", "features").alias("line"))
    path = _folder("export")
    user_files.write_user_files(got, path, order="line", files=2)
    back = user_files.read_user_files(spark, path, df, "line string").collect()
    assert sorted(map(tuple, back)) == [(1, "4.0 2:2.5 3:1.0"), (2, "3.0")]
    with pytest.raises(ValueError):
        user_files.write_user_files(df.withColumnRenamed("rating", "part"), path)


def test_empty_export(spark):
    path = _folder("export")
    empty = spark.createDataFrame([], "userid int, itemid int, prediction double")
    user_files.write_user_files(empty, path, files=2)
    assert user_files.read_user_files(spark, path, empty, "itemid int, prediction double").count() == 0


# -------------------------------------------------------------------- clusters

def test_pages_hold_every_item_once_and_mates_are_all_others(spark):
    rows = [(i, 0 if i % 3 else i % 5) for i in range(300)] + [(1000, None), (2000, 77)]
    assign = spark.createDataFrame(rows, "itemid int, cluster int")
    path = _folder("clusters")
    clusters.write_clusters(assign, path, page_items=16)
    pages = spark.read.parquet(os.path.join(path, "pages")).collect()
    by_cluster = {}
    for r in sorted(pages, key=lambda r: (r.cluster, r.page)):
        assert 1 <= len(r.ids) <= 16 and r.page == len(by_cluster.get(r.cluster, [])) // 16
        by_cluster.setdefault(r.cluster, []).extend(r.ids)
    want = {}
    for i, c in rows:
        if c is not None:
            want.setdefault(c, []).append(i)
    assert by_cluster == {c: sorted(v) for c, v in want.items()}
    req = spark.createDataFrame([(4,), (15,), (15,), (1000,), (2000,), (-5,)], "itemid int")
    got = {}
    for r in sorted(clusters.read_mates(spark, path, req).collect(), key=lambda r: (r.itemid, r.page)):
        got.setdefault(r.itemid, []).extend(r.similar_items)
    own = dict(rows)
    assert got == {i: sorted(set(want[own[i]]) - {i}) for i in (4, 15, 2000)}


def test_costs_of_the_centres_add_up_to_the_training_cost(spark):
    from affinis.operators import models

    f = q._features(spark, SF001)
    assign, centres = clusters.fit_clusters(f, 7, 1)
    same, cost = models.cluster_items(f, 7, 1)
    rows = centres.collect()
    assert len(rows) == 7 and sum(r.n_items for r in rows) == f.count()
    assert sum(r.cost for r in rows) == pytest.approx(cost, rel=1e-9)
    assert sorted(map(tuple, assign.collect())) == sorted(map(tuple, same.collect()))


def test_batch_writes_popular_items_and_cluster_lists(spark):
    log = tables.ratings_log(spark, SF001)
    as_of = log.select(F.max("ts")).first()[0]
    items = q._items(spark, SF001)
    paths = run_batch(spark, log, items, q._schema(), as_of, _folder("batch"),
                      Params().with_(hb_last_n_seconds=q.RECENCY_SECONDS, clusters_k=5, hybrid_top_k=20),
                      with_popular=True, with_clusters=True)
    read = {k: spark.read.parquet(p) for k, p in paths.items() if k != "cluster_lists"}
    assert read["popular"].count() > 0 and read["cluster_centres"].count() == 5
    member = {r.itemid: r.cluster for r in read["clusters"].collect()}
    assert len(member) == items.count()
    got = clusters.read_mates(spark, paths["cluster_lists"], spark.createDataFrame([(1,)], "itemid int")).collect()
    assert sorted(i for r in got for i in r.similar_items) == sorted(
        i for i, c in member.items() if c == member[1] and i != 1)
