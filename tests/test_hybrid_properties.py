"""Properties of blending, ranking, serving and padding."""

import pytest
from pyspark.sql import functions as F

from affinis.operators import hybrid as hyb
from affinis.operators.evaluate import sweep_weights


def _preds(spark):
    cf = spark.createDataFrame([(1, i, float(i % 5)) for i in range(1, 30)], "userid int, itemid int, prediction double")
    cb = spark.createDataFrame([(1, i, float((i * 7) % 11)) for i in range(1, 30) if i % 4],
                               "userid int, itemid int, prediction double")
    return cf, cb


def test_weight_one_ranks_as_cf_on_shared_pairs(spark):
    cf, cb = _preds(spark)
    h = [r.itemid for r in hyb.hybrid_topk(cf, cb, 1.0, 10).orderBy("rank").collect()]
    shared = cf.join(cb.select("userid", "itemid"), ["userid", "itemid"])
    c = [r.itemid for r in hyb.rank_predictions(shared, 10).orderBy("rank").collect()]
    assert h == c


def test_inner_join_drops_one_sided_pairs(spark):
    cf, cb = _preds(spark)
    items = {r.itemid for r in hyb.blend(cf, cb, 0.5).collect()}
    assert all(i % 4 for i in items) and len(items) == len([i for i in range(1, 30) if i % 4])
    outer = {r.itemid for r in hyb.blend(cf, cb, 0.5, how="outer").collect()}
    assert outer == set(range(1, 30))


def test_nan_predictions_never_rank(spark):
    df = spark.createDataFrame([(1, 1, float("nan")), (1, 2, 1.0), (1, 3, None)], "userid int, itemid int, prediction double")
    assert [r.itemid for r in hyb.rank_predictions(df).collect()] == [2]


def test_serve_fallback(spark):
    stored = spark.createDataFrame([(1, [5, 6, 7])], "userid int, recommended_ids array<int>")
    online = spark.createDataFrame([(1, [9]), (2, [8, 3])], "userid int, recommended_ids array<int>")
    users = spark.createDataFrame([(1,), (2,), (3,)], "userid int")
    got = {r.userid: (r.recommended_ids, r.source) for r in hyb.serve(users, stored, online, 2).collect()}
    assert got == {1: ([5, 6], "batch"), 2: ([8, 3], "online"), 3: ([], "none")}


def test_pad_lists_skips_owned_and_duplicates(spark):
    users = spark.createDataFrame([(1,), (2,)], "userid int")
    ranked = spark.createDataFrame([(1, 50, 1), (1, 51, 2)], "userid int, itemid int, rank int")
    popular = spark.createDataFrame([(51, 1), (60, 2), (61, 3)], "itemid int, rank int")
    newest = spark.createDataFrame([(70, 1), (60, 2)], "itemid int, rank int")
    owned = spark.createDataFrame([(2, 60)], "userid int, itemid int")
    got = {r.userid: r.recommended_ids for r in hyb.pad_lists(users, ranked, popular, newest, owned, 4).collect()}
    assert got == {1: [50, 51, 60, 61], 2: [51, 61, 70]}


def test_sweep_grid():
    w = sweep_weights()
    assert len(w) == 19 and w[0] == 0.1 and w[-1] == 1.0 and w[1] == 0.15


@pytest.mark.parametrize("k, block_items, max_blocks", [(5, 16, 2048), (5, 1000, 2048), (40, 16, 3), (290, 8, 64), (1, 1, 2048)])
def test_pruned_topk_equals_brute_force(spark, k, block_items, max_blocks):
    """Every branch: one block, many, few large ones, k beyond what is left,
    negative weights, ties, null and NaN vectors."""
    from affinis.operators import topk

    users = [(u, [u % 7, (u * 3) % 11], float(u % 5) - 2.0, [float(u % 4) - 1.5, 0.25 * (u % 3)]) for u in range(1, 41)]
    users += [(98, [1], 1.0, [float("nan"), 1.0]), (99, [], None, [1.0, 1.0])]
    rows = [(i, [float((i * 37) % 101) / 8.0, float(i % 5)]) for i in range(300)] + [(900, [None, 1.0]), (901, [float("nan"), 1.0])]
    prof = spark.createDataFrame(users, "userid int, owned array<int>, c double, p array<double>")
    items = spark.createDataFrame(rows, "itemid int, q array<double>")
    score = F.col("c") + F.col("p")[0] * F.col("q")[0] + F.col("p")[1] * F.col("q")[1]
    got = topk.pruned_topk(prof, items, score, k, [F.col("p")[0], F.col("p")[1]], [F.col("q")[0], F.col("q")[1]],
                           F.col("c"), block_items, max_blocks)
    want = []
    for u, owned, c, p in users[:40]:
        full = sorted((-(c + p[0] * q[0] + p[1] * q[1]), i) for i, q in rows[:300] if i not in owned)[:k]
        want += [(u, i, -v, n) for n, (v, i) in enumerate(full, 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_visits_equal_brute_force_without_an_expression(spark):
    """Scores summed in the visits; equal vectors tie and the smaller item wins;
    runs and segments so small that users visit several."""
    import numpy as np

    from affinis.operators import topk

    rng = np.random.default_rng(6)
    p, q = rng.normal(size=(150, 5)).round(2), rng.normal(size=(400, 5)).round(2)
    q[200:260] = q[7]
    owned = [sorted({int(x) for x in rng.integers(0, 400, u % 9)}) for u in range(150)]
    prof = spark.createDataFrame([(u, owned[u], p[u].tolist()) for u in range(150)], "userid int, owned array<int>, p array<double>")
    items = spark.createDataFrame([(i, q[i].tolist()) for i in range(400)], "itemid int, q array<double>")
    for k in (3, 60, 400):
        got = topk.pruned_topk(prof, items, None, k, [F.col("p")[j] for j in range(5)], [F.col("q")[j] for j in range(5)],
                               segment_items=20)
        rows = {(r.userid, r["rank"]): (r.itemid, r.prediction) for r in got.collect()}
        want = {}
        for u in range(150):
            scores = sum((p[u, j] * q[:, j] for j in range(5)), np.zeros(400))
            free = sorted((i for i in range(400) if i not in owned[u]), key=lambda i: (-scores[i], i))[:k]
            want |= {(u, n): (i, scores[i]) for n, i in enumerate(free, 1)}
        assert {x: v[0] for x, v in rows.items()} == {x: v[0] for x, v in want.items()}
        assert all(abs(rows[x][1] - want[x][1]) < 1e-9 for x in want)
    assert topk.pruned_topk(prof.limit(0), items, None, 3, [F.col("p")[0]], [F.col("q")[0]]).count() == 0
    assert topk.pruned_topk(prof, items.limit(0), None, 3, [F.col("p")[0]], [F.col("q")[0]]).count() == 0


def test_users_of_equal_scores_read_the_first_ids_only(spark):
    """A zero vector ties all items: only the k first unowned ids are met, beside
    users with a vector; a task gives k rows a user, however many items tie."""
    from affinis.operators import topk

    users = [(u, [0, 2, 5 + u % 3], float(u), [0.0, 0.0] if u % 4 else [0.0, 1.0]) for u in range(200)]
    prof = spark.createDataFrame(users, "userid int, owned array<int>, c double, p array<double>")
    items = spark.range(5000).selectExpr("cast(id as int) as itemid", "array(cast(id % 7 as double), cast(id % 2 as double)) as q")
    met = spark.sparkContext.accumulator(0)
    got = topk.pruned_topk(prof, items, None, 6, [F.col("p")[0], F.col("p")[1]], [F.col("q")[0], F.col("q")[1]], F.col("c"), met=met).collect()
    want = set()
    for u, owned, c, p in users:
        free = [i for i in range(5000) if i not in owned and (p[1] == 0 or i % 2)][:6]
        want |= {(u, i, c + p[1], n) for n, i in enumerate(free, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert met.value < 0.4 * 200 * 5000


@pytest.mark.parametrize("k, block_items", [(4, 64), (4, 4096), (120, 64)])
def test_tied_items_are_not_walked_one_by_one(spark, k, block_items):
    """Users whose vector has a zero tie all items that differ only there, and equal
    vectors tie for everybody: what is met follows the users, not the ties."""
    from affinis.operators import topk

    n = 6000
    vectors = [(1.0, 0.0), (0.0, -0.5), (1.0, 0.25), (0.0, 0.0), (-0.5, 0.0)]
    users = [(u, sorted({(u * 7 + 5 * j) % n for j in range(u % 40)} | {4, 9, 14}), 0.5 * u, list(vectors[u % 5])) for u in range(300)]
    prof = spark.createDataFrame(users, "userid int, owned array<int>, c double, p array<double>")
    rows = [(i, [float(i % 5), float(i * 17 % n // 600)]) for i in range(n)]
    items = spark.createDataFrame(rows, "itemid int, q array<double>")
    met = spark.sparkContext.accumulator(0)
    got = topk.pruned_topk(prof, items, None, k, [F.col("p")[0], F.col("p")[1]], [F.col("q")[0], F.col("q")[1]], F.col("c"),
                           segment_items=block_items, met=met).collect()
    want = set()
    for u, owned, c, p in users:
        own = set(owned)
        best = sorted((-(c + p[0] * q[0] + p[1] * q[1]), i) for i, q in rows if i not in own)[:k]
        want |= {(u, i, -s, r) for r, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert met.value < 300 * 4 * (2 * k + 32)


def test_id_lists_of_scattered_and_standing_rows(spark):
    import random

    rows = [(u, u * 1000 + 7 * r, r) for u in range(40) for r in range(1, 1 + u)]
    rows += [(None, 5, 1), (None, 6, 2), (0, 9, 1)]
    want = {}
    for u, i, r in sorted(rows, key=lambda x: x[2]):
        want.setdefault(u, []).append(i)
    for order in ("standing", "scattered"):
        if order == "scattered":
            random.Random(4).shuffle(rows)
        df = spark.createDataFrame(rows, "userid int, itemid int, rank int").repartition(3)
        for standing in (True, False):
            plan = hyb.id_lists(df, standing=standing)
            assert plan.schema.simpleString() == "struct<userid:int,recommended_ids:array<int>>"
            assert {r.userid: r.recommended_ids for r in plan.collect()} == want
    pieces = spark.createDataFrame([(1, [7, 3], 4), (1, [9, 8, 2], 1), (2, [5], 1)], "userid int, itemid array<int>, rank int")
    assert {r.userid: r.recommended_ids for r in hyb.id_lists(pieces).collect()} == {1: [9, 8, 2, 7, 3], 2: [5]}


def test_id_lists_put_standing_ids_together():
    """What is shuffled for lists is a few rows a user, not a row an id."""
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"_k": [1] * 500 + [2] * 500, "_r": [*range(1, 501)] * 2, "_i": [*range(1000)]})
    got = pa.Table.from_batches(hyb._pieces([b])).to_pydict()
    assert got == {"_k": [1, 2], "_r": [1, 1], "_ids": [[*range(500)], [*range(500, 1000)]]}


def test_partitions_hold_users_in_order(spark):
    """``write_predictions(in_order=True)`` counts on it."""
    from affinis.operators import topk

    users = [(u * 7919 % 1000, [u % 50], [0.0, 0.0] if u % 3 else [1.0, (u % 11) / 4.0]) for u in range(300)]
    prof = spark.createDataFrame(users, "userid int, owned array<int>, p array<double>").repartition(4)
    items = spark.range(900).selectExpr("cast(id as int) as itemid", "array(cast(id % 7 as double), cast(id % 13 as double)) as q")
    got = topk.pruned_topk(prof, items, None, 20, [F.col("p")[0], F.col("p")[1]], [F.col("q")[0], F.col("q")[1]])
    rows = got.select(F.spark_partition_id().alias("part"), "userid", "rank").collect()
    assert len(rows) == 300 * 20 and len({r.part for r in rows}) > 2
    place = {}
    for r in rows:
        place.setdefault(r.part, []).append((r.userid, r["rank"]))
    assert all(v == sorted(v) for v in place.values())
    assert len({(part, u) for part, v in place.items() for u, _ in v}) == 300
    lists = topk.pruned_topk(prof, items, None, 20, [F.col("p")[0], F.col("p")[1]], [F.col("q")[0], F.col("q")[1]], lists=True)
    assert {tuple(r) for r in hyb.id_lists(lists).select("userid", F.posexplode("recommended_ids")).collect()} == {
        (r.userid, r["rank"] - 1, r.itemid) for r in got.collect()}


def test_first_ids_of_equal_vectors_over_batches():
    import numpy as np

    from affinis.operators import topk

    rng = np.random.default_rng(3)
    q = np.sort(rng.integers(0, 6, 500)).astype(float)[:, None]
    own, ids, cut = np.zeros(500, np.int32), np.arange(500), np.r_[0, np.sort(rng.integers(0, 500, 40)), 500]
    firsts = topk._Firsts(7)
    kept = np.concatenate([firsts(own[a:z], q[a:z], ids[a:z]) for a, z in zip(cut[:-1], cut[1:]) if z > a])
    want = np.concatenate([np.arange((q[:, 0] == v).sum()) < 7 for v in range(6)])
    assert (kept == want).all()


def test_scores_given_as_a_function_rank_bit_for_bit(spark):
    from affinis.operators import topk

    users = [(u, [u], 0.1 * u) for u in range(60)]
    prof = spark.createDataFrame(users, "userid int, owned array<int>, m double")
    rows = [(i, (i * 37 % 11) / 3.0, float(i % 50)) for i in range(900)]
    items = spark.createDataFrame(rows, "itemid int, a double, b double")
    got = topk.pruned_topk(prof, items, lambda u, v: hyb.blend_values(v[:, 0], u[:, 0] + v[:, 1] / 50.0, 0.1), 150,
                           [F.lit(0.1), F.lit(0.9 / 50.0)], [F.col("a"), F.col("b")], F.col("m") * 0.9, segment_items=32, own=[F.col("m")])
    want = set()
    for u, owned, m in users:
        best = sorted((-(a * 0.1 + (m + b / 50.0) * (1.0 - 0.1)), i) for i, a, b in rows if i not in owned)[:150]
        want |= {(u, i, -s, n) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got.collect()} == want


def _run_of(p, c, owned, k):
    """One run of users on the driver, its floors unknown."""
    import numpy as np
    import pyarrow as pa

    from affinis.operators import topk

    n = len(p)
    users = pa.table({"u": pa.array(np.arange(n)), "p": pa.array(p.tolist()), "c": pa.array(c), "own": pa.array([[]] * n, pa.list_(pa.float64())),
                      "owned": pa.array(owned, pa.list_(pa.int64())), "t": pa.array([None] * n, pa.float64())})
    return topk._Run(users, p.shape[1], k, 1e3, None, False)


def test_walks_meet_few_pairs_of_a_long_list():
    """Items too short for a user's floor are left out in long lists too (before, 64
    users shared a list and met 0.81 of these pairs)."""
    import numpy as np

    rng = np.random.default_rng(3)
    p, q = rng.normal(size=(400, 10)), rng.normal(size=(24_000, 10)) * rng.lognormal(0, 0.5, size=(24_000, 1))
    q = q[np.argsort(-np.abs(q).sum(axis=1))]
    run = _run_of(p, np.zeros(400), [[]] * 400, 100)
    for at in range(0, len(q), 2000):
        run.walk(np.arange(at, at + 2000), q[at:at + 2000])
        run.settle()
    got = {int(u): set(i[x].tolist()) for u, i, x in ((u, i, us == u) for us, i, _, _ in run.ranked() for u in np.unique(us))}
    assert all(got[u] == set(np.argpartition(-(q @ p[u]), 100)[:100].tolist()) for u in range(400))
    assert run.met < 0.3 * len(p) * len(q)


@pytest.mark.parametrize("scale, shift, k", [(1.0, 0.0, 5), (1e-20, 0.0, 5), (1.0, 1e7, 5), (1e25, 0.0, 120), (1.0, 1e7, 120), (1e-25, 1e-25, 120)])
def test_bounds_in_four_bytes_lose_nothing(scale, shift, k):
    """Large, small and shifted vectors, ties, owned items: as brute force."""
    import numpy as np

    rng = np.random.default_rng(8)
    p, q = rng.normal(size=(90, 3)).round(2), (rng.normal(size=(1500, 3)).round(2) * scale + shift)
    p[:, 0] *= 1e3
    q[300:340] = q[7]
    owned = [sorted({int(x) for x in rng.integers(0, 1500, u % 40)}) for u in range(90)]
    run = _run_of(p, np.arange(90) * scale, owned, k)
    run.margin = 2e-9 * np.sqrt((run.p ** 2).sum(axis=1)) * np.abs(q).max()
    for at in range(0, 1500, 250):
        run.walk(np.arange(at, at + 250), q[at:at + 250])
        run.settle()
    got = {}
    for us, items, _, ranks in run.ranked():
        for u, i, r in zip(us.tolist(), items.tolist(), ranks.tolist()):
            got[u, r] = i
    for u in range(90):
        s = np.full(1500, u * scale)
        for j in range(3):
            s = s + p[u, j] * q[:, j]
        free = sorted(set(range(1500)) - set(owned[u]), key=lambda i: (-s[i], i))[:k]
        assert [got[u, r] for r in range(1, k + 1)] == free


def test_runs_of_short_lists_are_few():
    """What is sent is runs x items: with short lists 32 runs hold two million users."""
    from affinis.operators import topk

    assert topk.run_users(2_000_000, 10) * 32 >= 2_000_000
    assert topk.run_users(2_000_000, 1000) * 1000 <= 1 << 23 and topk.run_users(100, 10) == 64


def test_cf_topk_needs_no_longer_lists_for_heavy_owners(spark):
    """One user owns nearly the whole catalogue: the others' lists stay k long
    (before, every user's list was k + the largest number of owned items)."""
    from affinis.operators import models
    from affinis.params import Params

    r = spark.range(4000).selectExpr("cast(id % 40 as int) as userid", "cast(id * 7 % 97 as int) as itemid",
                                     "cast(1 + id * id % 5 as double) as rating").dropDuplicates(["userid", "itemid"])
    heavy = spark.range(95).selectExpr("41 as userid", "cast(id as int) as itemid", "3.0D as rating")
    r = r.where("itemid % 3 = userid % 3").unionByName(heavy)
    model = models.fit_als(r, Params())
    got = models.cf_topk(model, r.select("userid"), r, 4)
    scores = {(x.userid, x.itemid): x.prediction for x in model.transform(r.select("userid").distinct().crossJoin(r.select("itemid").distinct())).collect()}
    owned = {(x.userid, x.itemid) for x in r.collect()}
    by_user = {}
    for x in got.collect():
        assert (x.userid, x.itemid) not in owned and abs(scores[x.userid, x.itemid] - x.prediction) < 1e-5
        by_user.setdefault(x.userid, []).append(x.prediction)
    for u in {u for u, _ in scores}:
        best = sorted((-s for (v, i), s in scores.items() if v == u and (v, i) not in owned))[:4]
        assert len(by_user[u]) == len(best) <= 4
        assert all(abs(a + b) < 1e-5 for a, b in zip(sorted(by_user[u], reverse=True), best))


def test_share_of_scores_met(spark):
    """Counts scores, not operator names: under a fifth of users x items for ten
    items by ALS factors, under a twentieth for the stand-ins, on sf0.1."""
    from affinis.operators import topk
    from affinis.plans import queries as q
    from affinis.session import stored

    sf, met = "/root/testdata/sf0.1", spark.sparkContext.accumulator(0)
    prof, items = (stored(t, "met") for t in q._model_candidates(spark, sf, True, False))
    d = q.Params().cf_rank
    assert topk.pruned_topk(prof, items, None, 10, q._parts("uf", d), q._parts("vf", d), met=met).count() == 10 * prof.count()
    assert 0 < met.value < 0.2 * prof.count() * items.count()
    w, spread, met = q.HYBRID_WEIGHT, q.base.CONTENT_SCALE, spark.sparkContext.accumulator(0)
    side = q.pop.item_stats(q._ratings(spark, sf)).join(q._items(spark, sf), "itemid").select("itemid", "mean_rating", "psize")
    topk.pruned_topk(prof, side, None, 10, [F.lit(w), F.lit((1 - w) / spread)], [F.col("mean_rating"), F.col("psize")], met=met)
    assert 0 < met.value < 0.05 * prof.count() * items.count()


def test_appended_rows_are_seen(spark, tmp_path):
    """A query built after an append reads the new rows, and queries leave no cache behind."""
    import shutil

    from affinis.plans import queries as q

    for t in ("orders", "lineitem"):
        (tmp_path / f"{t}.parquet").mkdir()
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet" / "part-0.parquet")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    before = q.REGISTRY["ratings_latest"](spark, str(tmp_path)).agg(F.max("userid"), F.count("*")).first()
    orders = spark.read.parquet(str(tmp_path / "orders.parquet")).limit(1)
    lines = spark.read.parquet(str(tmp_path / "lineitem.parquet")).limit(1)
    orders.withColumns({"o_orderkey": F.lit(-5).cast("long"), "o_custkey": F.lit(10**6).cast("long")}).select(orders.columns).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    lines.withColumn("l_orderkey", F.lit(-5).cast("long")).select(lines.columns).write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    after = q.REGISTRY["ratings_latest"](spark, str(tmp_path)).agg(F.max("userid"), F.count("*")).first()
    assert after[1] == before[1] + 1 and after[0] == 10**6
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_unrated_pairs_of_the_whole_catalogue(spark):
    """Every event pair with a catalogue item, less the rated ones, by plain sets."""
    from affinis.plans.queries import q_unrated_pairs, q_unrated_pairs_catalogue
    from affinis.sources import tables

    sf = "/root/testdata/sf0.001"
    number = lambda x: int(x) if x is not None and str(x).isdigit() else None
    given = {(number(r.user_id), number(r.item_id)) for r in tables.interactions_raw(spark, sf).collect()}
    parts = {r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    rated = {(r.userid, r.itemid) for r in tables.ratings(spark, sf).collect()}
    want = {p for p in given if p[1] in parts} - rated
    got = [tuple(r) for r in q_unrated_pairs_catalogue(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert want > {tuple(r) for r in q_unrated_pairs(spark, sf).collect()}


def test_user_models_roundtrip_resolves_the_log_once(spark, monkeypatch):
    """Fitting and scoring read the same stored ratings, and score by the saved models."""
    from affinis.plans import queries as q

    sf, resolved, ratings = "/root/testdata/sf0.001", [], q.tables.ratings
    monkeypatch.setattr(q.tables, "ratings", lambda *a: resolved.append(a) or ratings(*a))
    got = q.q_user_models_roundtrip(spark, sf).collect()
    assert len(resolved) == 1
    coefs = {r.userid: r for r in q.q_user_models(spark, sf).collect()}
    vectors = {r.itemid: r.features for r in q._features(spark, sf).collect()}
    assert got
    for r in got:
        want = coefs[r.userid].intercept + sum(a * b for a, b in zip(coefs[r.userid].coef, vectors[r.itemid]))
        assert abs(r.prediction - want) < 1e-9


def test_long_lists_rank_each_user_by_itself(spark):
    """Final ranks of users with fewer items than k, equal scores and scores of minus
    infinity among them: one order a user, no sort over all users' pairs."""
    import numpy as np
    import pyarrow as pa

    from affinis.operators import topk

    rng, n, k = np.random.default_rng(5), 60, 120
    users = pa.table({"u": np.arange(n)[::-1], "p": pa.array([[1.0]] * n), "c": np.zeros(n), "own": pa.array([[0.0]] * n),
                      "owned": pa.array([[]] * n, pa.list_(pa.int64())), "t": pa.nulls(n, pa.float64())})
    run, want = topk._Run(users, 1, k, 1.0, None, False), []
    for row in range(n):
        many = int(rng.integers(0, k + 1))
        items, scores = rng.permutation(500)[:many].astype(np.int64), rng.integers(0, 7, many).astype(float)
        scores[scores == 0] = -np.inf
        run.rows.append(np.full(many, row, np.int32)), run.items.append(items), run.scores.append(scores)
        best = sorted(zip(-scores, items))
        want += [(int(run.u[row]), int(i), float(-s), r) for r, (s, i) in enumerate(best, 1)]
    sorts, lexsort = [], np.lexsort
    topk.np.lexsort = lambda keys, *a: sorts.append(len(keys[0])) or lexsort(keys, *a)
    try:
        got = [(int(u), int(i), float(s), int(r)) for part in run.ranked() for u, i, s, r in zip(*part)]
    finally:
        topk.np.lexsort = lexsort
    assert got == sorted(want, key=lambda x: (x[0], x[3])) and not sorts


def test_popular_items_read_the_ratings_once(spark):
    """However many times the stats are used, and with the same rows as counted plainly."""
    from affinis.operators import popular as pop

    rows = [(u, u * i % 23, float(1 + (u + i) % 5)) for u in range(40) for i in range(1, 6)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    ratings = spark.createDataFrame(rows, "userid int, itemid int, rating double")
    ratings = ratings.mapInArrow(counted, ratings.schema)
    by_item = {}
    for _, i, r in rows:
        by_item.setdefault(i, []).append(r)
    for bound_on, bound in (("ratings", len(rows) // 10), ("items", len(by_item) // 10)):
        read.value = 0
        got = [(r.itemid, r.mean_rating, r.n_ratings) for r in pop.popular_items(ratings, bound_on).collect()]
        assert read.value == len(rows)
        best = sorted(by_item, key=lambda i: (-len(by_item[i]), i))[:bound]
        assert sorted(got) == sorted((i, sum(by_item[i]) / len(by_item[i]), len(by_item[i])) for i in best)
    assert pop.popular_items(ratings.limit(0)).count() == 0
