"""Tables that change: numbered manifests, and a keyed table with upserts.

A manifest is a small JSON file that names the data folders that count.  The
next one is published by renaming a finished file to a name that must not exist:
readers see all of a change or nothing, and of two writers the later one goes
again on the newer manifest.  What a lost attempt wrote is named nowhere.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.session import fanout_partitions
from affinis.sources.sinks import upsert_latest


class Folder:
    """The few file operations of a stored table, on whatever file system it lies."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf, self.root = spark._jsc.hadoopConfiguration(), root
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, *parts))

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, *parts: str) -> bool:
        """A new file with this text; False if the name is taken."""
        tmp, target = self.path(*parts[:-1], f"_{uuid.uuid4().hex}"), self.path(*parts)
        out = self.fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.conf)
        none = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(tmp), self.fs.makeQualified(target), none)
            return True
        except Exception:
            self.fs.delete(tmp, False)
            if self.fs.exists(target):
                return False
            raise

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)


class Manifests:
    """The numbered manifests of a folder (``manifest/v<number>``)."""

    def __init__(self, files: Folder):
        self.files = files

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self.files.names("manifest") if n.startswith("v"))

    def read(self, version: int | None = None) -> dict:
        at = self.versions()[-1] if version is None else version
        return json.loads(self.files.read("manifest", f"v{at}"))

    def publish(self, manifest: dict) -> bool:
        return self.files.publish(json.dumps(manifest), "manifest", f"v{manifest['version']}")

    def commit(self, change) -> dict:
        """Publish ``change(newest manifest)``, again on the newer one if another
        writer came first; None from ``change`` leaves things as they are."""
        while True:
            now = self.read()
            new = change(now)
            if new is None:
                return now
            new["version"] += 1
            if self.publish(new):
                return new


class KeyedTable:
    """SNK12 / SRC11: rows by key in a folder, one row a key, the last write wins.

    Rows lie in buckets by the hash of the key.  ``merge`` folds the incoming rows
    to the last of each key (a partial aggregate, so a key that comes a million
    times is one row before it moves), reads the buckets hit, and writes those
    anew; the files of the other buckets stay as they are.  A stored row with a
    later ``order`` stays; equal orders are decided by the other columns.  Null keys
    are keys, an empty batch changes nothing.  ``schema`` must not name ``bucket``."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], order: list[str],
                 buckets: int | None = None):
        self.spark, self.root, self.schema, self.keys, self.order = spark, root, schema, keys, order
        self.files = Folder(spark, root)
        self.log = Manifests(self.files)
        if not self.log.versions():
            self.log.publish({"version": 0, "buckets": buckets or fanout_partitions(spark), "at": {}})

    def _rows(self, manifest: dict, hit: list[int] | None = None) -> DataFrame:
        at = {b: part for b, part in manifest["at"].items() if hit is None or int(b) in hit}
        if not at:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        base = os.path.join(self.root, "data")
        paths = [os.path.join(base, part, f"bucket={b}") for b, part in sorted(at.items())]
        return (self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", base)
                .parquet(*paths).drop("part"))

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.log.read(version)).drop("bucket")

    def merge(self, incoming: DataFrame) -> dict:
        n = self.log.read()["buckets"]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int").alias("bucket")
        names = self.read().columns
        work = f"fold-{uuid.uuid4().hex}"
        last = upsert_latest(incoming.select(*names), self.keys, self.order).select(*names, bucket)
        last.write.parquet(os.path.join(self.root, "work", work))
        fold = self.spark.read.schema(last.schema).parquet(os.path.join(self.root, "work", work))
        hit = sorted(r[0] for r in fold.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        while hit:
            seen = self.log.read()
            part = f"part={uuid.uuid4().hex}"
            rows = self._rows(seen, hit).select(*names, "bucket").unionByName(fold)
            merged = upsert_latest(rows, [*self.keys, "bucket"], self.order).select(*names, "bucket")
            (merged.repartition(fanout_partitions(self.spark), "bucket").write.partitionBy("bucket")
             .parquet(os.path.join(self.root, "data", part)))
            mine = {str(b): part for b in hit}
            changed = []

            def swap(now: dict) -> dict | None:
                changed[:] = [b for b in mine if now["at"].get(b) != seen["at"].get(b)]
                return None if changed else {**now, "at": {**now["at"], **mine}}

            self.log.commit(swap)
            if not changed:
                break  # else: another writer's rows came into one of these buckets; merge with them
        self.files.delete("work", work)
        return self.log.read()
