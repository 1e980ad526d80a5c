"""Structured Streaming: interaction ingest and the incremental learner.

STR1  ``readStream`` of raw interaction files → weight resolution (a
      stream-static join with the action table) → valid events to the
      learner, invalid ones to a quarantine sink
STR2  stateful learner keyed by user: state = the user's item → weight map;
      an event that raises a weight emits the item-count delta and, for every
      other item j the user holds, the pair delta
      ``min(new, w_j) − min(cur, w_j)``.  Deltas only depend on that user's
      history, so no cross-key state is needed and the sums commute
STR3  similarity kept current = SIM4 over the summed delta log (compaction)
STR4  the users active in the last N seconds, from the same log

Sinks are Parquet folders under the shared checkpoint directory; every query
has its own checkpoint location, so a restarted query resumes exactly-once.
"""

from __future__ import annotations

import os
import uuid
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from affinis.operators import ingest
from affinis.session import ensure_checkpoint_dir

# pandas' notice about concatenating empty frames, raised inside pyspark's
# state serializer for users whose batch emits nothing
warnings.filterwarnings("ignore", message="The behavior of DataFrame concatenation")

RAW_EVENT_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, "
                    "value double, props string")
DELTA_SCHEMA = "kind string, item_a string, item_b string, delta double, seq long"
STATE_SCHEMA = "items map<string, double>"


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def raw_stream(spark: SparkSession, folder: str, file_glob: str = "*.parquet",
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw interaction files as a stream (schema declared, never inferred).

    ``folder/file_glob`` may be one file, or a table folder of part files."""
    from affinis.sources.tables import epoch_seconds

    table = os.path.join(folder, file_glob)
    reader = spark.readStream.schema(RAW_EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if "*" not in file_glob and _is_folder(spark, table):
        ev = reader.parquet(table)
    else:
        ev = reader.option("pathGlobFilter", file_glob).parquet(folder)
    return ev.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("item_id"), F.col("event_type").alias("action"),
        F.lit(None).cast("double").alias("rating"), epoch_seconds("ts").alias("ts"))


def learner_fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """STR2: one user's new events (in seq order) against the user's state."""
    items: dict[str, float] = dict(state.get[0]) if state.exists else {}
    rows = []
    events = pd.concat(list(pdfs)).sort_values("seq")
    for seq, item, w in zip(events["seq"], events["item_id"], events["weight"]):
        cur = items.get(item, 0.0)
        if not w > cur:
            continue
        rows.append(("item", item, None, float(w - cur), int(seq)))
        for other, wo in items.items():
            if other == item:
                continue
            d = min(w, wo) - min(cur, wo)
            if d != 0:
                a, b = (item, other) if item < other else (other, item)
                rows.append(("pair", a, b, float(d), int(seq)))
        items[item] = float(w)
    state.update((items,))
    if rows:
        yield pd.DataFrame(rows, columns=["kind", "item_a", "item_b", "delta", "seq"])


def learner_stream(valid_events: DataFrame) -> DataFrame:
    return (valid_events.select("user_id", "item_id", "weight", "seq")
            .groupBy("user_id")
            .applyInPandasWithState(learner_fn, DELTA_SCHEMA, STATE_SCHEMA, "append",
                                    GroupStateTimeout.NoTimeout))


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    w = (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def stream_deltas(spark: SparkSession, folder: str, actions: DataFrame, file_glob: str = "*.parquet",
                  base: str | None = None, max_files_per_trigger: int | None = None) -> tuple[str, str]:
    """STR1 + STR2 over all files now present; returns (delta folder,
    quarantine folder).  Both are under ``base``, which a restarted stream names
    again to go on where it stopped; without it, a fresh folder under the shared
    checkpoint directory."""
    root = base or os.path.join(ensure_checkpoint_dir(spark), "affinis-stream", uuid.uuid4().hex)
    raw = raw_stream(spark, folder, file_glob, max_files_per_trigger)
    resolved = ingest.resolve_weights(raw, actions)
    deltas_out, quarantine_out = os.path.join(root, "deltas"), os.path.join(root, "quarantine")
    q1 = run_to_parquet(learner_stream(ingest.valid(resolved)), deltas_out, os.path.join(root, "ck-deltas"))
    q2 = run_to_parquet(ingest.rejected(resolved), quarantine_out, os.path.join(root, "ck-quarantine"))
    q1.awaitTermination()
    q2.awaitTermination()
    return deltas_out, quarantine_out


def counts_from_deltas(deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STR3 compaction: summed deltas = item counts (SIM1), pair counts (SIM2)."""
    items = (deltas.filter(F.col("kind") == "item").groupBy(F.col("item_a").alias("item_id"))
             .agg(F.sum("delta").alias("item_count")))
    pairs = (deltas.filter(F.col("kind") == "pair").groupBy("item_a", "item_b")
             .agg(F.sum("delta").alias("pair_count")))
    return items, pairs


def active_from_log(events: DataFrame, as_of, seconds: int) -> DataFrame:
    """STR4: users with an event in the last ``seconds`` before ``as_of``."""
    return events.filter(F.col("ts") > F.lit(as_of) - F.lit(seconds)).select("user_id").distinct()
