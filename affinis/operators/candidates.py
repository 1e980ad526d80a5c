"""Ratings state, user sets, splits and candidate pairs.

WIN1  latest rating per (user, item)               — partial aggregate, no window
SRC10 ratings after a timestamp (optionally of a set of users)
FLT1  ratings of the last N seconds before ``as_of`` (strict ``>``)
FLT2  active users = distinct users of FLT1
FLT3  users of the last N rating rows of the log
FLT4  all users;  SET1 rated items;  SRC9 catalogue items
JOI4  unrated ones of given pairs (JOI5/JOI6: of catalogue items)
WIN2  per-user ordered train/test split;  WIN3 repeatable hash split
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.operators.prefix import ranged, row_numbers


def latest_ratings(log: DataFrame) -> DataFrame:
    """WIN1: the last rating per (user, item) by (ts, seq_major, seq_minor).

    ``max(struct(...))`` is combined map-side, so a (user, item) with a huge
    history costs one partial row per task, not one window partition.
    """
    last = F.max(F.struct("ts", "seq_major", "seq_minor", "rating"))
    return (log.groupBy("userid", "itemid").agg(last.alias("_l"))
            .select("userid", "itemid", F.col("_l.rating").alias("rating"),
                    F.col("_l.ts").alias("ts")))


def ratings_after(ratings: DataFrame, ts: int, users: DataFrame | None = None) -> DataFrame:
    """SRC10: ratings with ``ts > ts``; restricted to ``users`` when given
    (the reference ignores its user argument; the restriction is ours)."""
    r = ratings.filter(F.col("ts") > F.lit(ts))
    return r.join(users.select("userid"), "userid", "left_semi") if users is not None else r


def recent(ratings: DataFrame, as_of, seconds: int) -> DataFrame:
    """FLT1: ratings of the last ``seconds`` before ``as_of`` (strict);
    ``as_of`` may be a number or a (scalar-subquery) column."""
    return ratings.filter(F.col("ts") > F.lit(as_of) - F.lit(seconds))


def active_users(ratings: DataFrame, as_of: int, seconds: int) -> DataFrame:
    """FLT2: users with a rating in the window — a DataFrame, never a set."""
    return recent(ratings, as_of, seconds).select("userid").distinct()


def last_n_users(ratings: DataFrame, n: int) -> DataFrame:
    """FLT3: distinct users of the last ``n`` rows in log order (a top-n is
    the feature here; Spark plans it as a per-task top-n + merge of n rows)."""
    return (ratings.orderBy(F.col("ts").desc(), F.col("userid").desc(), F.col("itemid").desc())
            .limit(n).select("userid").distinct())


def all_users(ratings: DataFrame) -> DataFrame:
    return ratings.select("userid").distinct()


def rated_items(ratings: DataFrame) -> DataFrame:
    return ratings.select("itemid").distinct()


def catalogue_items(items: DataFrame) -> DataFrame:
    return items.select("itemid").distinct()


def user_profiles(ratings: DataFrame, as_of=None, seconds: int | None = None) -> DataFrame:
    """One row per user (active users when ``as_of`` is given): the owned
    items, mean rating, number of ratings and last rating time.

    One aggregation (map-side combined) serves candidate generation, the
    owned-item exclusion and every per-user model input, and leaves the
    rows hash-partitioned by user for everything downstream.  ``owned`` holds
    distinct item ids, so it is bounded by the catalogue, not by the log.

    With ``as_of``, the active users are found first from the recent ratings
    alone (a small distinct set that AQE broadcasts), and only their ratings
    are semi-joined in and aggregated, so the shuffle carries the active
    users' rows, not every user's.
    """
    if as_of is not None:
        active = recent(ratings, as_of, seconds).select("userid").distinct()
        ratings = ratings.join(active, "userid", "left_semi")
    return ratings.groupBy("userid").agg(
        F.collect_set("itemid").alias("owned"), F.avg("rating").alias("user_mean"),
        F.count(F.lit(1)).alias("n_ratings"), F.max("ts").alias("last_ts"))


def unrated_of(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """JOI4/JOI5/JOI6 for *given* pairs: those whose user has not rated the
    item (an anti join; nobody lists all users × items)."""
    return pairs.join(ratings.select("userid", "itemid"), ["userid", "itemid"], "left_anti")


def ordered_split(ratings: DataFrame, train_fraction: float = 0.7) -> DataFrame:
    """WIN2: per user, the first ``floor(f · n)`` ratings by (ts, itemid)
    are ``train``, the rest ``test``.  Rows are cut by range, so neither a
    user nor a bulk of equal times gathers in one window."""
    order = [F.col("ts"), F.col("itemid")]
    r = row_numbers(ranged(ratings, ["userid"], order), ["userid"], order, "_rn", "_n")
    train = F.col("_rn") <= F.floor(F.col("_n") * F.lit(train_fraction))
    return (r.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test")))
            .drop("_rn", "_n"))


def hash_split(ratings: DataFrame, train_percent: int = 80, seed: int = 0) -> DataFrame:
    """WIN3: repeatable pseudo-random split on (user, item)."""
    h = F.pmod(F.xxhash64(F.lit(seed), "userid", "itemid"), F.lit(100))
    return ratings.withColumn("split", F.when(h < train_percent, F.lit("train")).otherwise(F.lit("test")))
