"""Interaction ingest: weight resolution, validation, batch gate, acceptance.

PRJ4  weight = registered action weight, else the explicit rating; an event
      with both, with neither, with an unknown action or with a weight ≤ 0
      is rejected with a reason (the quarantine keeps it).
PRJ5  missing timestamp → ``as_of``.
PRJ6  ids → strings for the online path.
FLT8  all-or-nothing gate: one invalid event rejects its whole batch.
FE10  consecutive fixed-size batch ids over a total order.
FLT9  an event is accepted only if it raises the user's weight for the item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.operators.joins import sized_broadcast
from affinis.operators.prefix import ranged, row_numbers, running_agg

# Rejection reasons of the quarantine.
REASON_BOTH = "both_action_and_rating"
REASON_NEITHER = "no_action_no_rating"
REASON_UNKNOWN = "unknown_action"
REASON_NON_POSITIVE = "non_positive_weight"
REASON_NO_ID = "missing_id"
REASON_NO_WEIGHT = "weight_not_a_number"


def resolve_weights(raw: DataFrame, actions: DataFrame, as_of: int | None = None,
                    ) -> DataFrame:
    """Attach ``weight`` and ``reason`` (null when valid) to every raw event.

    ``raw`` has ``user_id, item_id, action, rating, ts`` (+ any extra columns);
    ``actions`` is the ``name, weight`` dimension, broadcast if its size is known to be small.
    An event is valid only with both ids and a weight that is a number above 0.
    """
    acts = sized_broadcast(
        actions.select(F.col("name").alias("_aname"), F.col("weight").alias("_aw")))
    j = raw.join(acts, raw.action == acts._aname, "left")
    has_a, has_r = F.col("action").isNotNull(), F.col("rating").isNotNull()
    weight = F.when(has_a, F.col("_aw")).otherwise(F.col("rating"))
    reason = (F.when(F.col("user_id").isNull() | F.col("item_id").isNull(), F.lit(REASON_NO_ID))
              .when(has_a & has_r, F.lit(REASON_BOTH))
              .when(~has_a & ~has_r, F.lit(REASON_NEITHER))
              .when(has_a & F.col("_aname").isNull(), F.lit(REASON_UNKNOWN))
              .when(weight.isNull() | F.isnan(weight.cast("double")), F.lit(REASON_NO_WEIGHT))
              .when(weight <= 0, F.lit(REASON_NON_POSITIVE)))
    ts = F.col("ts") if as_of is None else F.coalesce(F.col("ts"), F.lit(as_of).cast("long"))
    return (j.withColumn("weight", weight.cast("double"))
             .withColumn("reason", reason)
             .withColumn("ts", ts)
             .drop("_aname", "_aw"))


def valid(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("reason").isNull()).drop("reason")


def rejected(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("reason").isNotNull())


def batch_ids(df: DataFrame, order: str, size: int, out: str = "batch_id") -> DataFrame:
    """FE10: ``floor((row_number − 1) / size)`` over a total order, numbered
    by row ranges instead of one global window, however sparse the ids are."""
    d = row_numbers(ranged(df, [], [F.col(order)]), [], [F.col(order)], "_rn")
    return d.withColumn(out, F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")


def batch_gate(resolved: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """FLT8: keep the valid events of batches without any invalid event.

    The failing batches are found by a partial aggregate and removed with an
    anti join (AQE splits a hot batch on the streaming side).
    """
    bad = (resolved.filter(F.col("reason").isNotNull())
           .select(batch_col).distinct())
    return valid(resolved.join(bad, batch_col, "left_anti"))


def accepted_events(events: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """FLT9: events that raise the weight a user holds for an item.

    ``prev_weight`` is the maximum weight of the earlier events of the same
    (user, item) — skew-safe running max — and ``delta`` the raise.
    """
    r = running_agg(events, ["user_id", "item_id"], ["seq"], "weight", "max",
                    inclusive=False, bucket=bucket, out="prev_weight")
    prev = F.coalesce(F.col("prev_weight"), F.lit(0.0))
    return (r.withColumn("prev_weight", prev)
             .filter(F.col("weight") > F.col("prev_weight"))
             .withColumn("delta", F.col("weight") - F.col("prev_weight")))
