"""Join helpers: size-checked broadcast and id lookups (JOI12).

``sized_broadcast`` broadcasts a side whose size the optimizer can bound in
bytes; any other side is left to the join that Spark and AQE choose.  It runs no
job and caches nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's upper estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized_broadcast(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """``broadcast(df)`` if its plan is known to be at most ``max_bytes``, else ``df``."""
    return F.broadcast(df) if plan_bytes(df) <= max_bytes else df


def lookup(ids: DataFrame, table: DataFrame, key: str, found_col: str = "found") -> DataFrame:
    """JOI12: enrich a DataFrame of ids with the rows of ``table``.

    Missing ids stay, with ``found = false`` and null attributes (the
    reference's ``None``).  Works for one id, a list of ids or all of them.
    """
    t = table.withColumn("_hit", F.lit(True))
    j = ids.join(t, key, "left")
    return j.withColumn(found_col, F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")
