"""Replay similarity against a plain sequential simulation of the learner's
single-event rule, on the real event table (sf0.001)."""

from collections import defaultdict
from math import sqrt

from affinis.operators import ingest
from affinis.operators import similarity as sim
from affinis.params import Params
from affinis.sources import tables

SF = "/root/testdata/sf0.001"


def simulate(events):
    """events: (seq, user, item, weight) in any order → {(a, b): similarity}."""
    held: dict[str, dict[str, float]] = defaultdict(dict)
    count: dict[str, float] = defaultdict(float)
    pair: dict[tuple, float] = defaultdict(float)
    stored: dict[tuple, float] = {}
    for _, user, item, w in sorted(events):
        items = held[user]
        cur = items.get(item, 0.0)
        if not w > cur:
            continue
        count[item] += w - cur
        for other, wo in items.items():
            if other == item:
                continue
            key = (min(item, other), max(item, other))
            pair[key] += min(w, wo) - min(cur, wo)
            stored[key] = pair[key] / (sqrt(count[item]) * sqrt(count[other]))
        items[item] = w
    return stored, dict(count)


def test_replay_equals_sequential_simulation(spark):
    res = ingest.valid(ingest.resolve_weights(tables.interactions_raw(spark, SF), tables.actions_table(spark)))
    rows = [(r.seq, r.user_id, r.item_id, r.weight) for r in res.select("seq", "user_id", "item_id", "weight").collect()]
    want, want_counts = simulate(rows)
    for p in (Params(), Params(seq_bucket=64, pair_block_items=8)):
        out = sim.run(res, "replay", p)
        got = {(r.item_a, r.item_b): r.similarity for r in out["similarity"].collect()}
        assert got == want
        assert {r.item_id: r.item_count for r in out["counts"].collect()} == want_counts


def test_hot_user_holding_a_third_of_the_events(spark):
    """One user owns a third of all events (every third event is moved to
    user 'hot'); with a small pair block the hot user is split into many
    block pairs and the running aggregates into many seq buckets, and the
    result must still equal the sequential simulation (replay) and the
    final-weight formula (exact)."""
    from pyspark.sql import functions as F

    res = ingest.valid(ingest.resolve_weights(tables.interactions_raw(spark, SF), tables.actions_table(spark)))
    res = res.withColumn("user_id", F.when(F.col("seq") % 3 == 0, F.lit("hot")).otherwise(F.col("user_id")))
    rows = [(r.seq, r.user_id, r.item_id, r.weight) for r in res.select("seq", "user_id", "item_id", "weight").collect()]
    want, _ = simulate(rows)
    p = Params(seq_bucket=50, pair_block_items=10)
    got = {(r.item_a, r.item_b): r.similarity for r in sim.run(res, "replay", p)["similarity"].collect()}
    assert got == want

    # exact mode: P = Σ_u min(w_ui, w_uj), C = Σ_u w_ui over final weights
    final: dict = {}
    for _, u, i, w in rows:
        final[(u, i)] = max(final.get((u, i), 0.0), w)
    by_user: dict = defaultdict(dict)
    for (u, i), w in final.items():
        by_user[u][i] = w
    cnt: dict = defaultdict(float)
    pc: dict = defaultdict(float)
    for items in by_user.values():
        for i, w in items.items():
            cnt[i] += w
            for j, wj in items.items():
                if i < j:
                    pc[(i, j)] += min(w, wj)
    exact = {k: v / (sqrt(cnt[k[0]]) * sqrt(cnt[k[1]])) for k, v in pc.items()}
    got_exact = {(r.item_a, r.item_b): r.similarity for r in sim.run(res, "exact", p)["similarity"].collect()}
    assert got_exact == exact
