"""Skew-safe running aggregates and as-of lookups.

A plain ``sum(x) over (partition by key order by seq)`` puts every row of a
key in one task; a key holding a third of the log would then run in one
task.  :func:`running_agg` computes the same value in two levels:

1. rows are cut into ``seq`` buckets; the total of every (key, bucket) is a
   partial aggregate (map-side combined), and a window over the *bucket
   totals* of a key gives each bucket's offset.  A key has at most
   ``max(seq) / bucket`` bucket rows, not one row per event;
2. a window partitioned by (key, bucket) gives the running value inside the
   bucket; no window partition holds more than ``bucket`` ``seq`` values.

The result is offset ⊕ partial, for ``sum`` and ``max`` (both associative).

Where the order has no dense first column (times, scores, names, sparse ids),
:func:`row_numbers` cuts by *rows* instead: range partitioning by key and
order gives partitions of about equally many rows whatever their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.session import fanout_partitions, stored

_AGG = {"sum": F.sum, "max": F.max}


def running_agg(df: DataFrame, keys: list[str], order: list[str], value: str,
                fn: str = "sum", inclusive: bool = True, bucket: int = 1 << 20,
                out: str = "running") -> DataFrame:
    """Add column ``out``: ``fn(value)`` over the earlier rows of the same key.

    ``order`` must give a total order inside a key; its first column is a
    non-negative long used for bucketing.  ``inclusive`` includes the row
    itself.  Rows without predecessors get 0 for ``sum`` and null for ``max``.
    """
    agg = _AGG[fn]
    d = df.withColumn("_bkt", F.floor(F.col(order[0]) / F.lit(bucket)).cast("long"))

    totals = d.groupBy(*keys, "_bkt").agg(agg(value).alias("_btot"))
    w_b = (Window.partitionBy(*keys).orderBy("_bkt")
           .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, "_bkt", agg("_btot").over(w_b).alias("_boff"))

    w_in = (Window.partitionBy(*keys, "_bkt").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    d = d.withColumn("_part", agg(value).over(w_in))
    d = d.join(offsets, [*keys, "_bkt"], "left")
    if fn == "sum":
        res = F.coalesce(F.col("_boff"), F.lit(0)) + F.coalesce(F.col("_part"), F.lit(0))
    else:
        res = F.greatest(F.col("_boff"), F.col("_part"))
    return d.withColumn(out, res).drop("_bkt", "_boff", "_part")


def ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` range partitioned by (keys, order) and written to the shared
    folder once, with its partition as ``_bkt``: the cut points come from a
    sample of the rows, so no key and no value fills a partition alone."""
    cut = df.repartitionByRange(fanout_partitions(df.sparkSession), *[F.col(k) for k in keys], *order)
    return stored(cut.withColumn("_bkt", F.spark_partition_id()), "ranged")


def row_numbers(placed: DataFrame, keys: list[str], order: list[Column], out: str = "row_number",
                total: str | None = None) -> DataFrame:
    """1, 2, … per key in ``order`` on the rows of :func:`ranged` (keys not
    null, ``order`` total inside a key); ``total`` adds the key's row count.

    A window covers one key in one partition; the offsets of a key are one row
    for each partition it reaches."""
    counts = placed.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*keys)
    before = own.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(own).alias(total)] if total else []
    offsets = counts.select(*keys, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), *extra)
    within = F.row_number().over(Window.partitionBy(*keys, "_bkt").orderBy(*order))
    return (placed.withColumn("_in", within).join(offsets, [*keys, "_bkt"])
            .withColumn(out, F.col("_off") + F.col("_in")).drop("_bkt", "_off", "_in"))


def asof_sum(events: DataFrame, probes: DataFrame, key: str, seq: str, value: str,
             probe_key: str, probe_seq: str, out: str, bucket: int = 1 << 20,
             include_equal: bool = True) -> DataFrame:
    """For each probe row: sum of ``value`` of events with the same key and
    ``seq <= probe_seq`` (``<`` when ``include_equal`` is false).

    Probes are unioned into the event stream with value 0 and ordered after
    (or before) events of equal ``seq``, so one running sum answers all of
    them; probe columns are carried through unchanged.
    """
    tie_probe = 1 if include_equal else -1
    probe_cols = list(probes.columns)
    ev = events.select(
        F.col(key).alias("_k"), F.col(seq).cast("long").alias("_s"),
        F.lit(0).alias("_tie"), F.col(value).cast("double").alias("_v"),
        F.lit(False).alias("_probe"))
    pr = probes.select(
        F.col(probe_key).alias("_k"), F.col(probe_seq).cast("long").alias("_s"),
        F.lit(tie_probe).alias("_tie"), F.lit(0.0).alias("_v"),
        F.lit(True).alias("_probe"), *probe_cols)
    u = ev.unionByName(pr, allowMissingColumns=True)
    r = running_agg(u, ["_k"], ["_s", "_tie"], "_v", "sum", True, bucket, out)
    return r.filter(F.col("_probe")).select(*probe_cols, out)
