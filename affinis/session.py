"""Session helpers.

On a cluster the session comes from the launcher; these helpers only fill in
what is missing (tests, bench) and never override a cluster setting.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.host": "127.0.0.1",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def local_session(cpus: int | str = "*", app: str = "affinis", **conf) -> SparkSession:
    """A local session for tests and the bench (never used by the library)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**_LOCAL_DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set one only when unset.

    On a cluster this must be a shared folder (HDFS / object store), and a
    cluster without one is an error; a temporary folder serves a local master only.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="affinis-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, under the shared checkpoint
    directory (never a machine-local temporary folder on a cluster)."""
    import uuid

    return os.path.join(ensure_checkpoint_dir(spark), "affinis-" + name, uuid.uuid4().hex)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several jobs read into the shared folder once, and
    read it back (unlike a cache it outlives executors and is no session state)."""
    path = shared_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fanout_partitions(spark: SparkSession) -> int:
    """Partitions for the input of a fan-out step (a join whose output is
    far larger than its input).  AQE sizes partitions by *input* bytes and
    would merge a small input into one task; an explicit ``repartition(n,
    key)`` is kept as is, and n follows the cluster's shuffle setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
