"""Ingest rules, ERP cleaning, file sources and sinks on hand-written inputs."""

import os
import tempfile

from pyspark.sql import functions as F

from affinis.functions import columns as cols
from affinis.functions.schema import ItemSchema, decode_items
from affinis.operators import ingest
from affinis.sources import files, sinks
from affinis.sources.tables import actions_table

RAW = [  # seq, user, item, action, rating, ts
    (1, "1", "10", "click", None, 100),      # ok, action
    (2, "1", "11", None, 4.0, None),         # ok, rating, no timestamp
    (3, "2", "10", "click", 3.0, 101),       # both → rejected
    (4, "2", "12", None, None, 102),         # neither → rejected
    (5, "3", "13", "teleport", None, 103),   # unknown action → rejected
    (6, "3", "14", None, 0.0, 104),          # weight 0 → rejected
]


def _raw(spark):
    return spark.createDataFrame(RAW, "seq long, user_id string, item_id string, action string, "
                                      "rating double, ts long").withColumn("batch_id", F.floor(F.col("seq") / 3))


def test_resolve_weights_and_reasons(spark):
    res = ingest.resolve_weights(_raw(spark), actions_table(spark, [("click", 2.0)]), as_of=999)
    got = {r.seq: (r.weight, r.reason, r.ts) for r in res.collect()}
    assert got[1] == (2.0, None, 100)
    assert got[2] == (4.0, None, 999)
    assert got[3][1] == ingest.REASON_BOTH
    assert got[4][1] == ingest.REASON_NEITHER
    assert got[5][1] == ingest.REASON_UNKNOWN
    assert got[6][1] == ingest.REASON_NON_POSITIVE


def test_batch_gate_all_or_nothing(spark):
    res = ingest.resolve_weights(_raw(spark), actions_table(spark, [("click", 2.0)]))
    kept = sorted(r.seq for r in ingest.batch_gate(res).collect())
    assert kept == [1, 2]          # batch 0 = seq 1, 2 (valid); batch 1 = 3, 4, 5; batch 2 = 6


def test_batch_ids_consecutive(spark):
    df = spark.createDataFrame([(s,) for s in [5, 9, 12, 40, 41, 77, 78]], "seq long")
    got = [r.batch_id for r in ingest.batch_ids(df, "seq", 3).orderBy("seq").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2]


def test_accept_only_raises(spark):
    ev = spark.createDataFrame([(1, "u", "i", 2.0), (2, "u", "i", 1.0), (3, "u", "i", 2.0), (4, "u", "i", 5.0)],
                               "seq long, user_id string, item_id string, weight double")
    got = [(r.seq, r.prev_weight, r.delta) for r in ingest.accepted_events(ev, bucket=2).orderBy("seq").collect()]
    assert got == [(1, 0.0, 2.0), (4, 2.0, 3.0)]


def _write(folder, name, text):
    p = os.path.join(folder, name)
    with open(p, "w", newline="") as f:
        f.write(text)
    return p


def test_erp_orders_and_products(spark):
    d = tempfile.mkdtemp(prefix="affinis-erp-")
    o1 = _write(d, "orders_2016.csv",
                '"order_line/product_tmpl_id/id";"partner_id/id";"state"\r\n'
                '"x_12";"p_3";"Sales Order"\r\n"x_13";"p_3";"Done"\r\n"x_14";"p_4";"Cancelled"\r\n'
                '"";"p_5";"Done"\r\n')
    o2 = _write(d, "orders_2017.csv",
                '"order_line/product_tmpl_id/id";"partner_id/id";"state"\r\n"x_15";"p_9";"Done"\r\n')
    orders = files.read_erp_csv(spark, [o1, o2], files.ERP_ORDERS_SCHEMA)
    got = {(r.userid, r.itemid): (r.rating, r.reason) for r in files.erp_ratings(orders).collect()}
    assert got[(3, 12)] == (4.0, None)
    assert got[(3, 13)] == (5.0, None)
    assert got[(4, 14)] == (None, "unknown_state")
    assert got[(5, None)][1] == "empty_field"
    assert got[(9, 15)] == (5.0, None)

    p = _write(d, "products.csv", '"id";"categ_ids/.id"\r\n"x_1";"c_a"\r\n"";"c_b"\r\n"x_2";""\r\n'
                                  '"";"c_c"\r\n"x_3";"c_a"\r\n')
    prods = files.erp_products(files.read_erp_csv(spark, [p], files.ERP_PRODUCTS_SCHEMA))
    got = sorted((r.itemid, r.category) for r in prods.collect())
    # x_2 has no category: dropped before the fill, so "c_c" belongs to x_1
    assert got == [(1, "c_a"), (1, "c_b"), (1, "c_c"), (3, "c_a")]


def test_movies_and_ratings_csv(spark):
    d = tempfile.mkdtemp(prefix="affinis-csv-")
    m = _write(d, "movies.csv", 'movieId,title,genres\n1,"Heat, The (1995)",Action|Crime\n'
                                '2,Nothing (2000),(no genres listed)\n')
    mv = {r.itemid: r for r in files.read_movies_csv(spark, m).collect()}
    assert mv[1].title == "Heat, The (1995)" and mv[1].labels == "Action|Crime"
    from affinis.functions.features import one_hot_labels
    oh = {r.itemid: r.onehot for r in one_hot_labels(files.read_movies_csv(spark, m)).collect()}
    assert oh == {1: [1, 1], 2: [0, 0]}

    rp = _write(d, "ratings.csv", "userId,itemId,rating,timestamp\n1,2,4.5,99\nbad,line,x,1\n3,4,,7\n")
    assert files.read_ratings_csv(spark, rp).count() == 2
    assert files.read_ratings_csv(spark, rp, require_all=True).count() == 1


def test_id_lists_round_trip(spark):
    df = spark.createDataFrame([(1, "1:2:3"), (2, "")], "userid int, ids string")
    got = {r.userid: r.l for r in df.select("userid", cols.parse_id_list("ids").alias("l")).collect()}
    assert got == {1: [1, 2, 3], 2: []}


def test_libsvm_per_user_and_catalogue(spark):
    d = tempfile.mkdtemp(prefix="affinis-svm-")
    df = spark.createDataFrame([(1, 10, 4.0, [1.0, 0.0]), (1, 11, 3.0, [2.0, 5.0]), (2, 10, 1.0, [1.0, 0.0])],
                               "userid int, itemid int, rating double, features array<double>")
    sinks.write_libsvm(df, os.path.join(d, "users"), label="rating", partition_by="userid")
    back = files.read_libsvm(spark, os.path.join(d, "users", "userid=1"), 2)
    assert sorted((r.label, tuple(r.features)) for r in back.collect()) == [(3.0, (2.0, 5.0)), (4.0, (1.0, 0.0))]


def test_decode_items_quarantine(spark):
    sch = ItemSchema.parse('{"id": {"name": "itemid", "type": "int"}, "features": ['
                           '{"name": "f", "type": "double"}, {"name": "t", "type": "text"}]}')
    assert sch.numeric_features() == ["f"]
    docs = spark.createDataFrame([('{"itemid": 1, "f": 2.5, "t": "x"}',), ('{"f": 1.0}',), ("not json",)], "value string")
    got = [(r.itemid, r.f, r.reason) for r in decode_items(docs, sch).collect()]
    assert (1, 2.5, None) in got
    assert sum(1 for g in got if g[2] is not None) == 2


def test_upsert_and_register(spark):
    log = spark.createDataFrame([(1, 1, 3.0, 5), (1, 1, 4.0, 9), (2, 1, 1.0, 1)], "userid int, itemid int, rating double, ts long")
    got = sorted(tuple(r) for r in sinks.upsert_latest(log, ["userid", "itemid"], ["ts"]).collect())
    assert got == [(1, 1, 4.0, 9), (2, 1, 1.0, 1)]
    old = actions_table(spark, [("click", 2.0)])
    new = actions_table(spark, [("click", 9.0), ("buy", 5.0)])
    assert [r.name for r in sinks.register_new(old, new, "name").collect()] == ["buy"]


def test_csv_sinks_and_model_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="affinis-sinks-")
    pred = spark.createDataFrame([(1, 10, 4.5), (1, 11, 3.0), (2, 10, 2.0)], "userid int, itemid int, prediction double")
    sinks.write_predictions_csv(pred, os.path.join(d, "pred"))
    back = spark.read.option("header", True).csv(os.path.join(d, "pred", "userid=1"))
    assert sorted((int(r.itemid), float(r.prediction)) for r in back.collect()) == [(10, 4.5), (11, 3.0)]
    lists = spark.createDataFrame([(1, [3, 2, 1])], "userid int, recommended_ids array<int>")
    sinks.write_id_lists_csv(lists, os.path.join(d, "lists"))
    assert spark.read.option("header", True).csv(os.path.join(d, "lists")).first().ids == "3:2:1"

    from affinis.operators import models
    ratings = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(1, 6) for i in range(1, 8)],
                                    "userid int, itemid int, rating double")
    m = models.fit_als(ratings)
    sinks.save_als(m, os.path.join(d, "als"))
    m2 = sinks.load_als(os.path.join(d, "als"))
    a = sorted(tuple(r) for r in models.cf_predictions(m, ratings).collect())
    b = sorted(tuple(r) for r in models.cf_predictions(m2, ratings).collect())
    assert a == b and len(a) == 35


def test_ratings_csv_goes_by_header_name(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("itemId,userId,timestamp,rating\n7,1,99,4.5\n8,2\n9,3,98,3.0,extra\nx,4,97,2.0\n")
    got = [tuple(r) for r in files.read_ratings_csv(spark, str(p)).select("userid", "itemid", "rating", "timestamp").collect()]
    assert got == [(1, 7, 4.5, "99")]


def test_wrongly_typed_item_is_unparsable(spark):
    sch = ItemSchema.parse('{"id": {"name": "itemid", "type": "int"}, "features": [{"name": "f", "type": "double"}]}')
    rows = spark.createDataFrame([('{"itemid":1,"f":"abc"}',), ("not json",), ('{"f":1.0}',), ('{"itemid":2,"f":2}',)], "value string")
    assert [r.reason for r in decode_items(rows, sch).collect()] == ["unparsable", "unparsable", "missing_id", None]


def test_bad_weights_and_ids_are_rejected(spark):
    from affinis.operators import ingest

    acts = spark.createDataFrame([("buy", 5.0), ("broken", None)], "name string, weight double")
    raw = spark.createDataFrame(
        [("u", "i", None, float("nan")), ("u", "i", "broken", None), ("u", None, "buy", None), (None, "i", "buy", None),
         ("u", "i", "buy", 3.0), ("u", "i", None, None), ("u", "i", "nope", None), ("u", "i", None, -1.0), ("u", "i", "buy", None),
         ("u", "i", None, 2.5)], "user_id string, item_id string, action string, rating double").withColumn("ts", F.lit(None).cast("long"))
    raw = raw.coalesce(1).withColumn("at", F.monotonically_increasing_id())
    got = [(r.reason, r.weight, r.ts) for r in ingest.resolve_weights(raw, acts, as_of=7).orderBy("at").collect()]
    assert [g[0] for g in got] == [ingest.REASON_NO_WEIGHT, ingest.REASON_NO_WEIGHT, ingest.REASON_NO_ID, ingest.REASON_NO_ID,
                                   ingest.REASON_BOTH, ingest.REASON_NEITHER, ingest.REASON_UNKNOWN, ingest.REASON_NON_POSITIVE, None, None]
    assert [g[1] for g in got[-2:]] == [5.0, 2.5] and {g[2] for g in got} == {7}


def test_bad_ids_do_not_abort(spark):
    df = spark.createDataFrame([("x_12", "1:2"), ("x_abc", "1:x")], "a string, l string")
    got = df.select(cols.id_after_last("a").alias("a"), cols.parse_id_list("l").alias("l")).collect()
    assert [(r.a, r.l) for r in got] == [(12, [1, 2]), (None, [1])]


def test_register_new_keeps_the_first(spark):
    old = spark.createDataFrame([("view", 1.0)], "name string, weight double")
    new = spark.createDataFrame([("buy", 9.0, 2), ("buy", 4.0, 1), ("view", 3.0, 0)], "name string, weight double, seq int")
    assert [tuple(r) for r in sinks.register_new(old, new, "name", "seq").collect()] == [("buy", 4.0, 1)]


def test_forward_fill_tasks_follow_the_lines(spark, monkeypatch):
    """Long files are filled by many tasks of few lines, whatever the shuffle setting,
    and a value reaches lines many buckets later."""
    from pyspark.sql import functions as F

    from affinis.sources import files

    monkeypatch.setattr(files, "FILL_LINES", 500, raising=False)
    value = F.when((F.col("id") % 1000 == 3) | (F.col("id") % 1000 == 40), F.concat(F.lit("v"), "id")).otherwise(F.when(F.col("id") % 2 == 0, F.lit("")))
    lines = spark.range(20_000).select(F.concat(F.lit("f"), F.col("id") % 1).alias("_file"), F.col("id").alias("_line"), value.alias("v"))
    got = files.forward_fill(lines, "v", ["_file"], "_line", 100)
    sizes = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("v"), F.max("_file")).collect()
    assert max(r["count"] for r in sizes) <= 3000
    held, want = None, {}
    for r in lines.orderBy("_line").collect():
        held = r.v or held
        want[r["_line"]] = held
    assert {r["_line"]: r.v for r in got.collect()} == want
