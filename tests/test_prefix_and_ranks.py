"""Skew-safe running aggregates, as-of lookups and global ranks against brute force."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from affinis.operators.popular import count_rank
from affinis.operators.prefix import asof_sum, ranged, row_numbers, running_agg


def _rows(n=300, keys=4, seed=7):
    rnd = random.Random(seed)
    seqs = rnd.sample(range(5000), n)
    return [(rnd.randrange(keys), s, float(rnd.randint(1, 9))) for s in seqs]


@pytest.mark.parametrize("fn,inclusive", [("sum", True), ("sum", False), ("max", True), ("max", False)])
@pytest.mark.parametrize("bucket", [7, 100, 1 << 20])
def test_running_agg_matches_brute_force(spark, fn, inclusive, bucket):
    rows = _rows()
    df = spark.createDataFrame(rows, "k int, seq long, v double")
    got = {(r.k, r.seq): r.running for r in
           running_agg(df, ["k"], ["seq"], "v", fn, inclusive, bucket).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "seq", "v"]).sort_values("seq")
    for (k, s), val in got.items():
        prev = pdf[(pdf.k == k) & ((pdf.seq <= s) if inclusive else (pdf.seq < s))].v
        want = (prev.sum() if fn == "sum" else (prev.max() if len(prev) else None))
        assert val == want, (k, s, val, want)


def test_running_agg_without_keys_is_global_row_number(spark):
    df = spark.createDataFrame([(s, 1) for s in range(0, 50, 3)], "seq long, one int")
    got = sorted((r.seq, r.running) for r in running_agg(df, [], ["seq"], "one", "sum", True, 5).collect())
    assert [rn for _, rn in got] == list(range(1, len(got) + 1))


def test_asof_sum(spark):
    ev = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 2.0), ("b", 3, 4.0), ("a", 9, 8.0)],
                               "k string, seq long, v double")
    pr = spark.createDataFrame([("a", 5, "p1"), ("a", 4, "p2"), ("b", 2, "p3"), ("a", 100, "p4")],
                               "pk string, ps long, tag string")
    got = {r.tag: r.c for r in asof_sum(ev, pr, "k", "seq", "v", "pk", "ps", "c", bucket=2).collect()}
    assert got == {"p1": 3.0, "p2": 1.0, "p3": 0.0, "p4": 11.0}
    lt = {r.tag: r.c for r in asof_sum(ev, pr, "k", "seq", "v", "pk", "ps", "c", bucket=2,
                                        include_equal=False).collect()}
    assert lt["p1"] == 1.0


def test_count_rank_with_ties(spark):
    rows = [(i, c) for i, c in enumerate([5, 3, 5, 1, 3, 3, 9, 1, 5, 2])]
    df = spark.createDataFrame(rows, "itemid int, n_ratings long")
    got = {r.itemid: r.rank for r in count_rank(df, bucket=2).collect()}
    want = {item: rk for rk, (item, _) in
            enumerate(sorted(rows, key=lambda t: (-t[1], t[0])), start=1)}
    assert got == want


def test_row_numbers_with_a_hot_key_and_equal_times(spark):
    """One key with a third of the rows, all at one time; ids sparse over 62 bits."""
    rnd = random.Random(5)
    rows = [(0 if i % 3 == 0 else rnd.randrange(1, 40), 7 if i % 2 else rnd.randrange(9), rnd.getrandbits(62)) for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, ts long, id long")
    order = [F.col("ts").desc(), F.col("id")]
    placed = ranged(df, ["k"], order)
    sizes = [r["count"] for r in placed.groupBy("_bkt").count().collect()]
    assert len(sizes) > 1 and max(sizes) < len(rows) / 2
    pdf = pd.DataFrame(rows, columns=["k", "ts", "id"]).sort_values(["ts", "id"], ascending=[False, True])
    pdf["n"] = pdf.groupby("k").cumcount() + 1
    want = {(r.k, r.id): (r.n, (pdf.k == r.k).sum()) for r in pdf[:500].itertuples()}
    got = {(r.k, r.id): (r.n, r.m) for r in row_numbers(placed, ["k"], order, "n", "m").collect()}
    assert len(got) == len(rows) and all(got[k] == v for k, v in want.items())
    order = [F.col("id")]
    every = row_numbers(ranged(df, [], order), [], order).collect()
    assert [r.row_number for r in sorted(every, key=lambda r: r.id)] == list(range(1, len(rows) + 1))
    assert row_numbers(ranged(df.limit(0), [], order), [], order).count() == 0
