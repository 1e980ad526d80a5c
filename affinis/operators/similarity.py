"""Item-item similarity from weighted interactions (SIM1–SIM9).

Let ``w(u, i)`` be the largest weight user ``u`` gave item ``i`` (an event
counts only if it raises it, FLT9).  Then

* item count   ``C(i)    = Σ_u w(u, i)``                       (SIM1)
* pair count   ``P(i, j) = Σ_u min(w(u, i), w(u, j))``          (SIM2)
* similarity   ``P / (√C(i) · √C(j))``                          (SIM3/4)

The incremental learner of the reference writes a pair's similarity only
when an event touches the pair, so its stored value uses the counts *as of
the last touch*.  ``exact`` uses the final counts; ``replay`` reproduces the
stored values:

* the last touch of (i, j) is ``max_u max(last(u, i), last(u, j))`` over the
  users holding both, where ``last`` is the seq of the last accepted event;
  the item of that event is the "touch item" x, the other one y;
* ``C(x)`` and ``C(y)`` are the running item counts at that seq — an as-of
  lookup into the accepted-delta log (skew-safe, see ``prefix``).

Pairs come from a self-join of the (user, item, weight) state on the user.
A heavy user is split into ``ceil(m / pair_block_items)`` item blocks and
joined block × block, so no single task receives all pairs of one user; the
pair sums are partially aggregated before the shuffle on (item_a, item_b).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.operators.joins import sized_broadcast
from affinis.operators.prefix import asof_sum, ranged, row_numbers
from affinis.params import Params
from affinis.session import fanout_partitions


def user_item_state(events: DataFrame) -> DataFrame:
    """Final per-(user, item) weight and the seq of the last accepted event.

    The last accepted event is the earliest one reaching the final maximum
    (later equal weights are not raises), so a partial aggregate suffices:
    ``max(struct(weight, -seq))``.
    """
    top = F.max(F.struct(F.col("weight"), (-F.col("seq")).alias("nseq")))
    return (events.groupBy("user_id", "item_id").agg(top.alias("_t"))
            .select("user_id", "item_id", F.col("_t.weight").alias("w"),
                    (-F.col("_t.nseq")).alias("last_seq")))


def item_counts(state: DataFrame) -> DataFrame:
    """SIM1: ``C(i)`` (= Σ of accepted raises = Σ of final weights)."""
    return state.groupBy("item_id").agg(F.sum("w").alias("item_count"))


def _split_heavy_users(state: DataFrame, block_items: int) -> DataFrame:
    deg = state.groupBy("user_id").agg(F.count(F.lit(1)).alias("_m"))
    nblk = F.greatest(F.lit(1), F.ceil(F.col("_m") / F.lit(block_items))).cast("int")
    return (state.join(deg, "user_id")
            .withColumn("_nblk", nblk)
            .withColumn("_blk", F.pmod(F.xxhash64("item_id"), F.col("_nblk")).cast("int"))
            .drop("_m"))


def pair_rows(state: DataFrame, params: Params = Params()) -> DataFrame:
    """JOI8: one row per user and unordered item pair (item_a < item_b)."""
    st = _split_heavy_users(state, params.pair_block_items)
    fan = F.explode(F.sequence(F.lit(0), F.col("_nblk") - 1))
    left = st.select("user_id", F.col("item_id").alias("item_a"), F.col("w").alias("w_a"),
                     F.col("last_seq").alias("last_a"), F.col("_blk").alias("blk_a"),
                     fan.alias("blk_b"))
    right = st.select("user_id", F.col("item_id").alias("item_b"), F.col("w").alias("w_b"),
                      F.col("last_seq").alias("last_b"), F.col("_blk").alias("blk_b"),
                      fan.alias("blk_a"))
    n = fanout_partitions(state.sparkSession)
    keys = ["user_id", "blk_a", "blk_b"]
    return (left.repartition(n, *keys).join(right.repartition(n, *keys), keys)
            .filter(F.col("item_a") < F.col("item_b"))
            .drop("blk_a", "blk_b"))


def pair_counts(state: DataFrame, params: Params = Params()) -> DataFrame:
    """SIM2: ``P(i, j)`` plus the last touch (seq and touching item)."""
    p = pair_rows(state, params)
    touch = F.struct(
        F.greatest("last_a", "last_b").alias("seq"),
        F.when(F.col("last_a") > F.col("last_b"), F.col("item_a"))
         .otherwise(F.col("item_b")).alias("item"))
    return (p.groupBy("item_a", "item_b")
            .agg(F.sum(F.least("w_a", "w_b")).alias("pair_count"),
                 F.max(touch).alias("_touch"))
            .select("item_a", "item_b", "pair_count",
                    F.col("_touch.seq").alias("last_touch"),
                    F.col("_touch.item").alias("touch_item")))


def _sim(pc, ca, cb) -> F.Column:
    return F.col(pc) / (F.sqrt(F.col(ca)) * F.sqrt(F.col(cb)))


def similarity_exact(pairs: DataFrame, counts: DataFrame, params: Params = Params()) -> DataFrame:
    """SIM4: similarity with the final item counts."""
    c = sized_broadcast(counts)
    ca = c.select(F.col("item_id").alias("item_a"), F.col("item_count").alias("count_a"))
    cb = c.select(F.col("item_id").alias("item_b"), F.col("item_count").alias("count_b"))
    return (pairs.join(ca, "item_a").join(cb, "item_b")
            .withColumn("similarity", _sim("pair_count", "count_a", "count_b"))
            .select("item_a", "item_b", "pair_count", "count_a", "count_b", "similarity"))


def similarity_replay(pairs: DataFrame, accepted: DataFrame, params: Params = Params()) -> DataFrame:
    """SIM3: similarity as the incremental learner stored it (counts as of
    the pair's last touch)."""
    probes = pairs.select(
        "item_a", "item_b", "pair_count", "last_touch",
        F.explode(F.array(
            F.struct(F.col("touch_item").alias("probe_item"), F.lit("x").alias("role")),
            F.struct(F.when(F.col("touch_item") == F.col("item_a"), F.col("item_b"))
                      .otherwise(F.col("item_a")).alias("probe_item"),
                     F.lit("y").alias("role")))).alias("_p"))
    probes = probes.select("item_a", "item_b", "pair_count", "last_touch",
                           F.col("_p.probe_item").alias("probe_item"),
                           F.col("_p.role").alias("role"))
    looked = asof_sum(accepted.select("item_id", "seq", "delta"), probes,
                      key="item_id", seq="seq", value="delta",
                      probe_key="probe_item", probe_seq="last_touch",
                      out="count_asof", bucket=params.seq_bucket)
    g = (looked.groupBy("item_a", "item_b")
         .agg(F.first("pair_count").alias("pair_count"),
              F.max(F.when(F.col("role") == "x", F.col("count_asof"))).alias("count_x"),
              F.max(F.when(F.col("role") == "y", F.col("count_asof"))).alias("count_y")))
    return (g.withColumn("similarity", _sim("pair_count", "count_x", "count_y"))
            .select("item_a", "item_b", "pair_count", "count_x", "count_y", "similarity"))


def both_directions(sim: DataFrame) -> DataFrame:
    a = sim.select(F.col("item_a").alias("item_id"), F.col("item_b").alias("other_id"), "similarity")
    b = sim.select(F.col("item_b").alias("item_id"), F.col("item_a").alias("other_id"), "similarity")
    return a.unionByName(b)


def neighbours(sim: DataFrame, k: int = 10) -> DataFrame:
    """SIM5: top-k other items per item, similarity DESC then id ASC.

    ``row_number() <= k`` is planned as a per-partition group limit before
    the shuffle, so a popular item ships at most k rows per task.
    """
    w = Window.partitionBy("item_id").orderBy(F.col("similarity").desc(), F.col("other_id"))
    return (both_directions(sim).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def similar_items(neigh: DataFrame) -> DataFrame:
    """SIM6: the neighbour list headed by the item itself with similarity 1.

    The self row is derived from the items that have neighbours, so the
    output grows with the data (k + 1 rows per item)."""
    self_rows = (neigh.select("item_id").distinct()
                 .select("item_id", F.col("item_id").alias("other_id"),
                         F.lit(1.0).alias("similarity"), F.lit(0).alias("rank")))
    return neigh.unionByName(self_rows)


def score_rank(score: str = "score") -> F.Column:
    """Scores equal to 1e-9 are ties; ties go to the smaller item id."""
    return F.round(F.col(score), 9)


def recommend(state: DataFrame, neigh: DataFrame, n: int | None = None,
              params: Params = Params()) -> DataFrame:
    """SIM7: score(r) = Σ sim·w / Σ sim over the neighbour lists of the
    user's items; owned items removed; ranked per user.

    The neighbour table has at most k rows per item, so it is broadcast
    after a row check; a hot item then costs no shuffle skew.
    """
    nb = sized_broadcast(neigh.select("item_id", "other_id", "similarity"))
    j = state.select("user_id", "item_id", "w").join(nb, "item_id")
    sc = (j.groupBy("user_id", "other_id")
          .agg(F.sum(F.col("similarity") * F.col("w")).alias("_num"),
               F.sum("similarity").alias("_den"))
          .select("user_id", F.col("other_id").alias("item_id"),
                  (F.col("_num") / F.col("_den")).alias("score")))
    sc = sc.join(state.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    order = [score_rank().desc(), F.col("item_id")]
    if n is None:
        return row_numbers(ranged(sc, ["user_id"], order), ["user_id"], order, "rank")
    # with a limit Spark keeps n rows a user before the shuffle
    top = sc.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
    return top.filter(F.col("rank") <= n)


def run(events: DataFrame, mode: str = "exact", params: Params = Params()) -> dict:
    """SIM9: the whole batch learner over a resolved event log in seq order."""
    from affinis.operators.ingest import accepted_events

    # the final state is a plain aggregate of the events; only replay needs
    # the accepted-delta log (lazy: not computed in exact mode)
    acc = accepted_events(events, params.seq_bucket)
    state = user_item_state(events)
    counts = item_counts(state)
    pairs = pair_counts(state, params)
    if mode == "replay":
        sim = similarity_replay(pairs, acc, params)
    else:
        sim = similarity_exact(pairs, counts, params)
    neigh = neighbours(sim, params.neighbours)
    return {"accepted": acc, "state": state, "counts": counts, "pairs": pairs,
            "similarity": sim, "neighbours": neigh}
