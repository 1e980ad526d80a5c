"""Operator 2: longest-processing-time sharding of groups that stay together.

Rows of one group (here: equal texts) go to one shard, and the shards' sizes
come out near equal.  The heap schedules at most ``buckets`` + shards *
``fineness`` jobs whatever the input: a group larger than total / (shards *
fineness) is a job of its own (there can be no more than shards * fineness of
these), and the smaller groups are joined by hash into ``buckets`` jobs.  Jobs
go largest first to the least loaded shard.

Slots number a shard's rows from 0 without gaps.  Rows are spread over cells
(shard, hash of the row), counted per cell, and numbered within their cell from
its start, so a group with a third of all rows is numbered by many tasks.

Null and empty texts form one group of size 1 a row; equal rows
are kept, each with its slot; an empty table gives no rows; columns of the
input with other names are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import fanout_partitions, written


def schedule(jobs: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest processing time first: job -> shard.  Ties go by job name and
    by shard number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, size in sorted(jobs, key=lambda j: (-j[1], j[0])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign_groups(groups: DataFrame, shards: int, buckets: int = 4096, fineness: int = 64) -> DataFrame:
    """``groups``: group_key string, bytes long (one row a group).  Adds shard."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes").alias("n")).first().n or 0
    job = F.when(F.col("bytes") * F.lit(shards * fineness) > F.lit(total), F.concat(F.lit("g"), "group_key")).otherwise(
        F.concat(F.lit("b"), F.pmod(F.xxhash64("group_key"), F.lit(buckets)).cast("string")))
    named = groups.withColumn("job", job)
    jobs = [(r.job, r.n) for r in named.groupBy("job").agg(F.sum("bytes").alias("n")).collect()]
    plan = spark.createDataFrame(list(schedule(jobs, shards).items()), "job string, shard int")
    return named.join(F.broadcast(plan), "job").drop("job")


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``slot``: 0, 1, ... within each ``shard``, without a gap.  ``order``
    sorts the rows of a cell."""
    cells = fanout_partitions(rows.sparkSession)
    celled = rows.withColumn("cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = celled.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    run = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("cell_start"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(*order))
    # one row for each of shards x partitions cells
    return (celled.join(F.broadcast(starts), ["shard", "cell"])
            .withColumn("slot", (F.col("cell_start") + within - 1).cast("long")).drop("cell", "cell_start"))


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    body = F.col(text).cast("string")
    rows = written(docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.sha2(F.coalesce(body, F.lit("")), 256).alias("group_key")), "shard-rows")
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("bytes"))
    placed = assign_groups(written(groups, "shard-groups"), shards)
    joined = rows.join(placed.select("group_key", "shard"), "group_key").drop("group_key")
    return number_rows(joined, ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"))
