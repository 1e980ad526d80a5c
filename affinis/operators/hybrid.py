"""Blending, ranking, id lists, serving and padding.

ML11  hybrid = w · cf + (1 − w) · cb over the pairs present on both sides
      (JOI3, inner join), top-k per user (LIM1), then the id list (AGG6)
PRJ3  scaling by a weight;  FLT5 null / NaN predictions dropped first
SRT1  per-user ranking, prediction DESC, ties item ASC
SNK3  one ordered id list per user, all users at once
LIM3  the first n ids of a stored list
JOI13 serve: the stored batch list if the user has one, else the online list
ML17  final list: hybrid rank, padded with popular then newest items
SRC5  predictions of a set of users (semi join)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.functions.columns import join_id_list, usable_prediction


def rank_col(score: str = "prediction", key: str = "userid", item: str = "itemid") -> F.Column:
    """Per-user rank: score DESC, then item ASC.  Predictions are per-row
    expressions (bit-identical wherever computed), so they are ranked raw;
    a rounding key would cost a decimal conversion per candidate."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(item))
    return F.row_number().over(w)


def rank_predictions(pred: DataFrame, k: int | None = None, score: str = "prediction",
                     key: str = "userid", item: str = "itemid") -> DataFrame:
    """SRT1 / LIM1: rank per user, keep the top k (``row_number() <= k`` is
    executed as a per-task group limit before the shuffle)."""
    r = pred.filter(usable_prediction(score)).withColumn("rank", rank_col(score, key, item))
    return r.filter(F.col("rank") <= k) if k is not None else r


def blend_columns(cf: F.Column, cb: F.Column, weight: float) -> F.Column:
    """PRJ3 on columns: ``w · cf + (1 − w) · cb`` (same operation order as
    :func:`blend`)."""
    w = F.lit(float(weight))
    return cf * w + cb * (F.lit(1.0) - w)


def blend_values(cf, cb, weight: float):
    """:func:`blend_columns` on numpy columns, bit for bit."""
    return cf * float(weight) + cb * (1.0 - float(weight))


def blend(cf: DataFrame, cb: DataFrame, weight: float, how: str = "inner") -> DataFrame:
    """JOI3 + PRJ3: ``w · cf + (1 − w) · cb`` on (userid, itemid).

    ``how="inner"`` is the reference: a pair missing on either side
    disappears.  ``how="outer"`` keeps it with the present side only.
    """
    a = cf.filter(usable_prediction()).select("userid", "itemid", F.col("prediction").alias("_cf"))
    b = cb.filter(usable_prediction()).select("userid", "itemid", F.col("prediction").alias("_cb"))
    j = a.join(b, ["userid", "itemid"], "inner" if how == "inner" else "full_outer")
    w = F.lit(float(weight))
    if how == "inner":
        p = F.col("_cf") * w + F.col("_cb") * (F.lit(1.0) - w)
    else:
        p = (F.when(F.col("_cb").isNull(), F.col("_cf"))
             .when(F.col("_cf").isNull(), F.col("_cb"))
             .otherwise(F.col("_cf") * w + F.col("_cb") * (F.lit(1.0) - w)))
    return j.select("userid", "itemid", p.alias("prediction"))


def hybrid_topk(cf: DataFrame, cb: DataFrame, weight: float, k: int = 1000) -> DataFrame:
    """ML11: blended predictions, top k per user."""
    return rank_predictions(blend(cf, cb, weight), k)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rank, item) rows as (key, first rank, items), a row for the rows of one key
    with consecutive ranks that stand together."""
    for b in batches:
        if not b.num_rows:
            continue
        key, rank = b.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(), b.column(1).to_numpy()
        new = np.r_[True, (key[1:] != key[:-1]) | (rank[1:] != rank[:-1] + 1)]
        first = np.flatnonzero(new)
        items = pa.ListArray.from_arrays(pa.array(np.r_[first, b.num_rows], pa.int32()), b.column(2))
        at = pa.array(first)
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), items], names=["_k", "_r", "_ids"])


def id_lists(ranked: DataFrame, key: str = "userid", item: str = "itemid",
             rank: str = "rank", standing: bool = False) -> DataFrame:
    """AGG6 / SNK3: ids ordered by rank, one row per user.  Lists are built
    from already-bounded (top-k) input; a rank occurs once a user.  ``item`` may hold
    arrays: the ids from that rank on, of which the pieces of a user are joined.
    ``standing``: long lists whose rows mostly stand in order are put together in
    pieces before the shuffle, so that it carries ids, not rows."""
    if standing or isinstance(ranked.schema[item].dataType, T.ArrayType):
        rows = ranked.select(F.col(key).alias("_k"), F.col(rank).cast("long").alias("_r"), F.col(item).alias("_ids"))
        if standing:
            kind, ids = rows.schema["_k"].dataType.simpleString(), rows.schema["_ids"].dataType.simpleString()
            rows = rows.mapInArrow(_pieces, f"_k {kind}, _r long, _ids array<{ids}>")
        l = F.array_sort(F.collect_list(F.struct("_r", "_ids")))
        return rows.groupBy(F.col("_k").alias(key)).agg(F.flatten(F.transform(l, lambda s: s["_ids"])).alias("recommended_ids"))
    l = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("i"))))
    return ranked.groupBy(key).agg(F.transform(l, lambda s: s["i"]).alias("recommended_ids"))


def id_list_text(lists: DataFrame) -> DataFrame:
    """The stored text form ``"1:2:3"``."""
    return lists.select("userid", join_id_list("recommended_ids").alias("recommended_ids"))


def take(lists: DataFrame, n: int, col: str = "recommended_ids") -> DataFrame:
    """LIM3."""
    return lists.withColumn(col, F.slice(F.col(col), 1, n))


def predictions_for(pred: DataFrame, users: DataFrame) -> DataFrame:
    """SRC5: predictions of a set of users."""
    return pred.join(users.select("userid"), "userid", "left_semi")


def serve(users: DataFrame, stored: DataFrame, online: DataFrame, n: int) -> DataFrame:
    """JOI13: per requested user the first n ids of the stored batch list;
    users without one get the online list; unknown users an empty list.

    ``stored`` and ``online`` have ``userid, recommended_ids`` (arrays).
    """
    u = users.select("userid").distinct()
    s = stored.select("userid", F.col("recommended_ids").alias("_s"))
    o = online.select("userid", F.col("recommended_ids").alias("_o"))
    j = u.join(s, "userid", "left").join(o, "userid", "left")
    ids = F.coalesce(F.col("_s"), F.col("_o"), F.array().cast("array<int>"))
    src = (F.when(F.col("_s").isNotNull(), F.lit("batch"))
           .when(F.col("_o").isNotNull(), F.lit("online")).otherwise(F.lit("none")))
    return j.select("userid", F.slice(ids, 1, n).alias("recommended_ids"), src.alias("source"))


def pad_lists(users: DataFrame, hybrid_ranked: DataFrame, popular_ids: DataFrame,
              newest_ids: DataFrame, owned: DataFrame, n: int) -> DataFrame:
    """ML17: per user the hybrid ranking, padded with the most popular and
    then the newest items, without duplicates and owned items; first n.

    ``popular_ids`` / ``newest_ids`` are ``itemid, rank`` tables already cut
    to n rows, so each user meets at most 2n padding rows, attached as one
    literal-sized array (no join of users with items).
    """
    def pad_array(t: DataFrame, src: int):
        return (t.select(F.array_sort(F.collect_list(F.struct(
            F.lit(src).alias("src"), F.col("rank").cast("long").alias("r"),
            F.col("itemid").alias("itemid"))))).scalar())

    u = users.select("userid").distinct()
    padded = (u.withColumn("_p", F.concat(pad_array(popular_ids, 1), pad_array(newest_ids, 2)))
              .select("userid", F.explode("_p").alias("_c"))
              .select("userid", F.col("_c.itemid").alias("itemid"),
                      F.col("_c.src").alias("src"), F.col("_c.r").alias("r")))
    hyb = (hybrid_ranked.join(u, "userid", "left_semi")
           .select("userid", "itemid", F.lit(0).alias("src"), F.col("rank").cast("long").alias("r")))
    c = hyb.unionByName(padded).join(owned.select("userid", "itemid"), ["userid", "itemid"], "left_anti")
    best = c.groupBy("userid", "itemid").agg(F.min(F.struct("src", "r")).alias("_b"))
    w = Window.partitionBy("userid").orderBy(F.col("_b.src"), F.col("_b.r"), F.col("itemid"))
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return id_lists(ranked)


def top_n(df: DataFrame, n: int, order: list) -> DataFrame:
    """A global top-n table with its rank (n rows; Spark merges per-task top-n)."""
    t = df.orderBy(*order).limit(n)
    w = Window.orderBy(*order)
    return t.withColumn("rank", F.row_number().over(w))
