"""The maintained similarity store: learner state, counts and active users.

A folder under the shared checkpoint directory holds five tables, each a log of
parts (one Parquet folder a batch, or several batches merged):

    state       user, item -> largest weight; by bucket of the user     (max)
    deltas      what each batch added to item and pair counts           (sum)
    seen        user -> newest event time                               (max)
    quarantine  rejected events with their reason                       (append)
    recs        lists of the users scored again, with the batch         (newest)

A manifest names the parts that count.  Manifests are numbered files; the next
one is published by renaming a finished file to a name that must not exist, so
a reader sees all of a batch or nothing, and of two writers one retries.  Parts
written by a lost attempt are named nowhere.

STR2  ``apply`` takes a micro-batch of resolved events.  A batch id that the
      manifest already holds is skipped, so a replay changes nothing.  Only the
      state buckets of the batch's users are read.  The change of a pair's count
      is ``min(new) - min(old)`` over the items whose weight rose, joined with all
      items of the user; a heavy user is split into blocks of items joined block
      by block.  All of it is DataFrame joins and map-side combined sums.
STR3  ``similarity`` reads the parts of one manifest.  ``fan`` parts of a level
      are merged into one of the next, so a row is rewritten a logarithmic number
      of times and a read meets a base and a short tail.  ``compact`` merges up to
      a batch id.  Folders that an older manifest names stay until ``vacuum``.
STR4  with ``active_seconds``, users of the batch inside the window that ends at
      the newest event are scored again, those alone; merged parts of ``seen``
      drop users that have left the window.

Null or non-positive weights and null ids never reach the state (ingest rejects
them).  An empty batch writes no parts.  Repeated events change nothing.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import ingest
from affinis.operators import similarity as sim
from affinis.params import Params
from affinis.session import ensure_checkpoint_dir, fanout_partitions
from affinis.sources.manifest import Folder, Manifests
from affinis.streaming.learner import raw_stream

SCHEMAS = {
    "state": "user_id string, item_id string, w double, last_seq long, bucket int",
    "deltas": "kind string, item_a string, item_b string, delta double, seq long",
    "seen": "user_id string, ts long",
    "quarantine": "seq long, user_id string, item_id string, action string, reason string",
    "recs": "user_id string, item_id string, score double, rank int, batch long, as_of long",
}
FILES_A_BUCKET = 8  # tasks over which one bucket (one heavy user) is written


def _names(table: str) -> list[str]:
    return [field.split()[0] for field in SCHEMAS[table].split(", ")]


class SimilarityStore:
    """Open the store at ``root``, or make it there.  ``buckets`` (as many as the
    session's shuffle partitions) and ``active_seconds`` are fixed when it is made."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, fan: int = 8,
                 active_seconds: int | None = None, params: Params = Params()):
        self.spark, self.root, self.fan, self.params = spark, root, fan, params
        self.files = Folder(spark, root)
        self.log = Manifests(self.files)
        if not self.log.versions():
            first = {"version": 0, "last_batch": -1, "max_ts": None, "buckets": buckets or fanout_partitions(spark),
                     "active_seconds": active_seconds, "tables": {t: [] for t in SCHEMAS}}
            self.log.publish(first)

    # ------------------------------------------------------------ manifests

    def manifest(self, version: int | None = None) -> dict:
        return self.log.read(version)

    def _commit(self, change) -> dict:
        return self.log.commit(change)

    # ---------------------------------------------------------------- parts

    def _write(self, table: str, df: DataFrame, first: int, last: int, level: int) -> dict:
        name = f"part={first}-{last}-{uuid.uuid4().hex}"
        out = df.select(*_names(table))
        if table == "state":
            n = fanout_partitions(self.spark)
            out = out.repartition(n, "bucket", F.pmod(F.xxhash64("item_id"), F.lit(FILES_A_BUCKET)))
            out.write.partitionBy("bucket").parquet(os.path.join(self.root, table, name))
        else:
            out.write.parquet(os.path.join(self.root, table, name))
        return {"name": name, "first": first, "last": last, "level": level}

    def _parts(self, table: str, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[table])
        paths = [os.path.join(self.root, table, p["name"]) for p in parts]
        found = self.spark.read.schema(SCHEMAS[table]).option("basePath", os.path.join(self.root, table)).parquet(*paths)
        return found.select(*_names(table))

    def _folded(self, table: str, df: DataFrame, m: dict) -> DataFrame:
        """The rows of several parts as the rows of one."""
        if table == "state":
            top = F.max(F.struct("w", (-F.col("last_seq")).alias("n")))
            return (df.groupBy("bucket", "user_id", "item_id").agg(top.alias("t"))
                    .select("user_id", "item_id", "t.w", (-F.col("t.n")).alias("last_seq"), "bucket"))
        if table == "deltas":
            return df.groupBy("kind", "item_a", "item_b").agg(F.sum("delta").alias("delta"), F.max("seq").alias("seq"))
        if table == "seen":
            newest = df.groupBy("user_id").agg(F.max("ts").alias("ts"))
            if m["active_seconds"] is None or m["max_ts"] is None:
                return newest
            return newest.where(F.col("ts") > m["max_ts"] - m["active_seconds"])
        if table == "recs":
            newest = df.groupBy("user_id").agg(F.max("batch").alias("batch"))
            return df.join(newest, ["user_id", "batch"], "left_semi")
        return df

    def table(self, name: str, m: dict | None = None) -> DataFrame:
        """A table as one manifest (the newest) has it."""
        m = m or self.manifest()
        return self._folded(name, self._parts(name, m["tables"][name]), m)

    # ------------------------------------------------------------- the learner

    def _touched(self, fold: DataFrame, m: dict) -> DataFrame:
        """All items of the batch's users: user, item, old and new weight."""
        hit = [r[0] for r in fold.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        held = self._parts("state", m["tables"]["state"]).where(F.col("bucket").isin(hit))
        held = self._folded("state", held, m).join(fold.select("user_id").distinct(), "user_id", "left_semi")
        old = held.select("bucket", "user_id", "item_id", F.col("w").alias("old"), F.col("last_seq").alias("s"))
        both = old.join(fold, ["bucket", "user_id", "item_id"], "full")
        was, got = F.coalesce("old", F.lit(0.0)), F.coalesce("w", F.lit(0.0))
        return both.select("bucket", "user_id", "item_id", was.alias("old"), F.greatest(was, got).alias("new"),
                           F.when(got > was, F.col("last_seq")).otherwise(F.col("s")).alias("last_seq"))

    def _pair_rows(self, touched: DataFrame) -> DataFrame:
        """Each item that rose with each other item of its user, block by block."""
        rose = F.col("new") > F.col("old")
        size = (touched.groupBy("user_id").agg(F.count(F.lit(1)).alias("m"), F.max(rose).alias("any"))
                .where("any").drop("any"))
        blocks = F.ceil(F.col("m") / F.lit(self.params.pair_block_items)).cast("int")
        cut = (touched.join(size, "user_id").withColumn("n", blocks)
               .withColumn("b", F.pmod(F.xxhash64("item_id"), F.col("n")).cast("int")))
        every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
        x = cut.where(rose).select("user_id", F.col("item_id").alias("x"), F.col("old").alias("x_old"),
                                   F.col("new").alias("x_new"), F.col("b").alias("bx"), every.alias("by"),
                                   F.col("last_seq").alias("x_seq"))
        y = cut.select("user_id", F.col("item_id").alias("y"), F.col("old").alias("y_old"), F.col("new").alias("y_new"),
                       F.col("b").alias("by"), every.alias("bx"), F.when(rose, F.col("last_seq")).alias("y_seq"))
        n, keys = fanout_partitions(self.spark), ["user_id", "bx", "by"]
        pairs = x.repartition(n, *keys).join(y.repartition(n, *keys), keys)
        both_rose = F.col("y_new") > F.col("y_old")  # such a pair meets twice: once is enough
        pairs = pairs.where((F.col("x") < F.col("y")) | ((F.col("x") > F.col("y")) & ~both_rose))
        change = F.least("x_new", "y_new") - F.least("x_old", "y_old")
        return pairs.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"),
                            change.alias("delta"), F.greatest("x_seq", "y_seq").alias("seq")).where("delta <> 0")

    def _pair_changes(self, touched: DataFrame) -> DataFrame:
        sums = [F.sum("delta").alias("delta"), F.max("seq").alias("seq")]
        return (self._pair_rows(touched).groupBy("item_a", "item_b").agg(*sums)
                .select(F.lit("pair").alias("kind"), "item_a", "item_b", "delta", "seq"))

    def _work(self, df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(self.root, "work", name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def apply(self, resolved: DataFrame, batch_id: int, rescore: int | None = None) -> dict:
        """One micro-batch of resolved events (``ingest.resolve_weights``).
        ``rescore``: length of the lists of the active users scored again."""
        m = self.manifest()
        if batch_id <= m["last_batch"]:
            return m
        attempt = f"{batch_id}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(m["buckets"])).cast("int").alias("bucket")
        top = F.max(F.struct(F.col("weight").alias("w"), (-F.col("seq")).alias("n")))
        fold = self._work(ingest.valid(resolved).groupBy(bucket, "user_id", "item_id")
                          .agg(top.alias("t"), F.max("ts").alias("ts"))
                          .select("bucket", "user_id", "item_id", "t.w", (-F.col("t.n")).alias("last_seq"), "ts"),
                          f"fold-{attempt}")
        one = lambda table, df: self._write(table, df, batch_id, batch_id, 0)
        made = {"quarantine": one("quarantine", ingest.rejected(resolved))}
        count, newest = fold.agg(F.count(F.lit(1)), F.max("ts")).first()
        if count:
            touched = self._work(self._touched(fold, m), f"touched-{attempt}")
            rose = touched.where("new > old")
            items = (rose.groupBy("item_id").agg(F.sum(F.col("new") - F.col("old")).alias("delta"),
                                                 F.max("last_seq").alias("seq"))
                     .select(F.lit("item").alias("kind"), F.col("item_id").alias("item_a"),
                             F.lit(None).cast("string").alias("item_b"), "delta", "seq"))
            made["state"] = one("state", rose.withColumnRenamed("new", "w"))
            made["deltas"] = one("deltas", items.unionByName(self._pair_changes(touched)))
            made["seen"] = one("seen", fold.groupBy("user_id").agg(F.max("ts").alias("ts")))

        def add(at: dict) -> dict | None:
            if batch_id <= at["last_batch"]:
                return None
            tables = {t: [*p, made[t]] if t in made else p for t, p in at["tables"].items()}
            top_ts = max((t for t in (at["max_ts"], newest) if t is not None), default=None)
            return {**at, "tables": tables, "last_batch": batch_id, "max_ts": top_ts}

        if rescore and count and m["active_seconds"] is not None:
            after = add(m)  # as it will be; nothing is published yet
            users = (self._parts("seen", [made["seen"]])
                     .where(F.col("ts") > after["max_ts"] - m["active_seconds"]).select("user_id"))
            lists = self.recommend(users, rescore, after)
            made["recs"] = one("recs", lists.withColumns({"batch": F.lit(batch_id).cast("long"),
                                                          "as_of": F.lit(after["max_ts"]).cast("long"),
                                                          "rank": F.col("rank").cast("int")}))
        self._commit(add)
        self.files.delete("work", f"fold-{attempt}")
        self.files.delete("work", f"touched-{attempt}")
        return self._merge_levels()

    # -------------------------------------------------------------- compaction

    def _replace(self, table: str, parts: list[dict], level: int) -> dict:
        """One merged part in place of ``parts``, wherever the log stands by then."""
        m, gone = self.manifest(), [p["name"] for p in parts]
        merged = self._write(table, self._folded(table, self._parts(table, parts), m),
                             parts[0]["first"], parts[-1]["last"], level)

        def swap(at: dict) -> dict | None:
            now = at["tables"][table]
            if not set(gone) <= {p["name"] for p in now}:
                return None  # another compaction came first
            place = [p["name"] for p in now].index(gone[0])
            rest = [p for p in now if p["name"] not in gone]
            return {**at, "tables": {**at["tables"], table: [*rest[:place], merged, *rest[place:]]}}

        return self._commit(swap)

    def _merge_levels(self) -> dict:
        m = self.manifest()
        for table in SCHEMAS:
            while True:
                levels: dict[int, list[dict]] = {}
                for p in m["tables"][table]:
                    levels.setdefault(p["level"], []).append(p)
                full = min((lv for lv, ps in levels.items() if len(ps) >= self.fan), default=None)
                if full is None:
                    break
                m = self._replace(table, levels[full], full + 1)
        return m

    def compact(self, up_to: int | None = None) -> dict:
        """Merge all parts up to a batch id (all batches) into one base a table."""
        m = self.manifest()
        for table in SCHEMAS:
            old = [p for p in m["tables"][table] if up_to is None or p["last"] <= up_to]
            if len(old) > 1:
                m = self._replace(table, old, max(p["level"] for p in old) + 1)
        return m

    def vacuum(self, keep: int = 2) -> int:
        """Remove part folders named by no manifest from the ``keep`` newest on, and
        older manifests.  For a store that no writer is at work on; readers of
        the kept manifests are not disturbed."""
        versions = self.log.versions()
        kept = versions[-keep:]
        named = {(t, p["name"]) for v in kept for t, ps in self.manifest(v)["tables"].items() for p in ps}
        stale = [(t, n) for t in SCHEMAS for n in self.files.names(t) if (t, n) not in named]
        stale += [("work", n) for n in self.files.names("work")]
        for v in versions[:-keep]:
            self.files.delete("manifest", f"v{v}")
        for folder, name in stale:
            self.files.delete(folder, name)
        return len(stale)

    # ----------------------------------------------------------------- reading

    def counts(self, m: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """Item counts (SIM1) and pair counts (SIM2)."""
        d = self.table("deltas", m)
        return (d.where("kind = 'item'").select(F.col("item_a").alias("item_id"), F.col("delta").alias("item_count")),
                d.where("kind = 'pair'").select("item_a", "item_b", F.col("delta").alias("pair_count")))

    def similarity(self, m: dict | None = None) -> DataFrame:
        """STR3: the similarity of all pairs (SIM4) as of one manifest."""
        m = m or self.manifest()
        items, pairs = self.counts(m)
        return sim.similarity_exact(pairs, items, self.params)

    def active_users(self, m: dict | None = None) -> DataFrame:
        """STR4: users seen in the last ``active_seconds`` before the newest event."""
        m = m or self.manifest()
        seen = self.table("seen", m)
        if m["active_seconds"] is None:
            return seen.select("user_id")
        return seen.where(F.col("ts") > F.lit(m["max_ts"]).cast("long") - m["active_seconds"]).select("user_id")

    def recommend(self, users: DataFrame, n: int, m: dict | None = None) -> DataFrame:
        """SIM7 for these users alone: only pairs with an item they hold are scored."""
        m = m or self.manifest()
        held = self.table("state", m).join(users.distinct(), "user_id", "left_semi")
        mine = held.select(F.col("item_id")).distinct()
        items, pairs = self.counts(m)
        ends = F.explode(F.array("item_a", "item_b")).alias("item_id")
        touched = pairs.select("*", ends).join(mine, "item_id", "left_semi").drop("item_id").distinct()
        near = sim.neighbours(sim.similarity_exact(touched, items, self.params), self.params.neighbours)
        return sim.recommend(held, near.join(mine, "item_id", "left_semi"), n, self.params)


def stream_to_store(spark: SparkSession, folder: str, actions: DataFrame, file_glob: str = "*.parquet",
                    base: str | None = None, max_files_per_trigger: int | None = None,
                    active_seconds: int | None = None, rescore: int | None = None, **store) -> SimilarityStore:
    """STR1 to STR4 over all files now present.  The stream's own checkpoint lies
    in the store's folder, so a restart under the same ``base`` goes on where it
    stopped; without ``base``, a fresh store under the shared checkpoint directory."""
    root = base or os.path.join(ensure_checkpoint_dir(spark), "affinis-store", uuid.uuid4().hex)
    kept = SimilarityStore(spark, root, active_seconds=active_seconds, **store)
    resolved = ingest.resolve_weights(raw_stream(spark, folder, file_glob, max_files_per_trigger), actions)
    query = (resolved.writeStream.foreachBatch(lambda df, batch_id: kept.apply(df, batch_id, rescore) and None)
             .option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    return kept
