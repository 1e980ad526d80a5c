"""Export of rows by user without a folder per user (SNK7, SNK9).

The rows are sorted by user and cut into a given number of CSV files with a header; an
index says which files and rows hold a user.  A user with very many rows spans
several files, small users share one.  Layout below the path::

    data/part=0/…csv   userid, row, columns …   (row counts from 0 in each part)
    index/…parquet     userid, part, first_row, n_rows
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.session import fanout_partitions

_ROW = (1 << 33) - 1  # low bits of monotonically_increasing_id: the place in its partition


def libsvm_line(label: str, features: str) -> F.Column:
    """SNK9: ``label i:v …`` (indices from 1, zeros left out)."""
    places = F.transform(F.col(features), lambda v, i: F.when(v != 0, F.concat_ws(
        ":", (i + 1).cast("string"), v.cast("string"))))
    return F.concat_ws(" ", F.col(label).cast("double").cast("string"), F.array_compact(places))


def write_user_files(df: DataFrame, path: str, order: str = "itemid", files: int | None = None) -> None:
    """Write ``userid, <other columns>`` sorted by user and ``order``, replacing ``path``.

    Column names ``part`` and ``row`` are the layout's own (a ValueError if taken); users
    of null are left out.  The index is made from the written files, so it holds
    whatever attempt of a task wrote them."""
    taken = {"part", "row"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} belong to the layout")
    n = files or fanout_partitions(df.sparkSession)
    rest = [c for c in df.columns if c != "userid"]
    cut = (df.filter(F.col("userid").isNotNull()).repartitionByRange(n, "userid", order)
           .withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "userid", order)
           .select("part", "userid", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias("row"), *rest))
    data = os.path.join(path, "data")
    cut.write.mode("overwrite").partitionBy("part").option("header", True).csv(data)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != "part")
    index = (df.sparkSession.read.schema(f"{types}, part int").option("header", True).csv(data)
             .groupBy("userid", "part").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n_rows")))
    index.sort("userid", "part").write.mode("overwrite").parquet(os.path.join(path, "index"))


def read_user_files(spark: SparkSession, path: str, users: DataFrame, schema: str) -> DataFrame:
    """The rows of ``users`` (``userid``): only the parts that the index names are read.

    ``schema`` declares the other columns in their order of writing.  What passes the
    driver are the numbers of those parts, at most one per file."""
    wanted = users.select("userid").distinct()
    index = spark.read.parquet(os.path.join(path, "index")).join(wanted, "userid", "left_semi")
    parts = [r.part for r in index.select("part").distinct().collect()]
    kind = dict(index.dtypes)["userid"]
    data = (spark.read.schema(f"userid {kind}, row long, {schema}, part int").option("header", True)
            .csv(os.path.join(path, "data")))
    return data.filter(F.col("part").isin(parts)).join(wanted, "userid", "left_semi").drop("row", "part")
