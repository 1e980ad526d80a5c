"""The stateful streaming learner: summed deltas equal the batch statistics."""

import os
import tempfile

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from affinis.operators import similarity as sim
from affinis.sources.tables import actions_table
from affinis.streaming import learner

from conftest import GOLDEN_ACTIONS, GOLDEN_EVENTS


def _write_golden_files(folder, parts):
    """The golden events as raw event files (one file per micro-batch)."""
    base = pd.Timestamp("2024-01-01")
    chunks = [GOLDEN_EVENTS[i::parts] for i in range(parts)] if parts > 1 else [GOLDEN_EVENTS]
    for n, chunk in enumerate(chunks):
        df = pd.DataFrame({
            "event_id": [s for s, *_ in chunk],
            "ts": [base + pd.Timedelta(seconds=s) for s, *_ in chunk],
            "user_id": [int(u[1:]) for _, u, _, _ in chunk],
            "event_type": [a for *_, a in chunk],
            "value": [0.0] * len(chunk),
            "props": ['{"k": "%s"}' % i for _, _, i, _ in chunk],
        })
        df["ts"] = df["ts"].astype("datetime64[us]")
        pq.write_table(pa.Table.from_pandas(df, preserve_index=False), os.path.join(folder, f"part{n}.parquet"))


def test_stream_deltas_equal_batch_counts(spark, golden):
    folder = tempfile.mkdtemp(prefix="affinis-stream-in-")
    _write_golden_files(folder, 1)
    base = tempfile.mkdtemp(prefix="affinis-stream-out-")
    out, quarantine = learner.stream_deltas(spark, folder, actions_table(spark, GOLDEN_ACTIONS), base=base)
    items, pairs = learner.counts_from_deltas(spark.read.parquet(out))
    batch = sim.run(golden.withColumn("user_id", F.regexp_replace("user_id", "u", "")), "exact")
    assert {r.item_id: r.item_count for r in items.collect()} == \
        {r.item_id: r.item_count for r in batch["counts"].collect()}
    assert {(r.item_a, r.item_b): r.pair_count for r in pairs.collect()} == \
        {(r.item_a, r.item_b): r.pair_count for r in batch["pairs"].collect()}
    assert spark.read.parquet(quarantine).count() == 0


def test_micro_batches_do_not_change_the_sums(spark):
    """Golden events split over 3 files (3 micro-batches, out of seq order
    across batches): the sums telescope to the final weights."""
    f1, f3 = tempfile.mkdtemp(prefix="affinis-s1-"), tempfile.mkdtemp(prefix="affinis-s3-")
    _write_golden_files(f1, 1)
    _write_golden_files(f3, 3)
    acts = actions_table(spark, GOLDEN_ACTIONS)
    o1, _ = learner.stream_deltas(spark, f1, acts, base=tempfile.mkdtemp(prefix="affinis-o1-"))
    o3, _ = learner.stream_deltas(spark, f3, acts, base=tempfile.mkdtemp(prefix="affinis-o3-"))
    a = learner.counts_from_deltas(spark.read.parquet(o1))
    b = learner.counts_from_deltas(spark.read.parquet(o3))
    assert sorted(a[0].collect()) == sorted(b[0].collect())
    assert sorted(a[1].collect()) == sorted(b[1].collect())


def test_stream_reads_a_table_folder_and_resumes(spark, tmp_path):
    """A table that is a folder of part files, in several micro-batches, stopped
    and started again under the same checkpoint: the sums of one batch run."""
    import shutil

    from affinis.sources.tables import actions_table

    whole = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table = tmp_path / "events.parquet"
    for i in range(4):
        part = whole.where(f"event_id % 4 = {i}").coalesce(1)
        part.write.parquet(str(tmp_path / f"p{i}"))
    table.mkdir()

    def add(i):
        (src,) = (tmp_path / f"p{i}").glob("part-*.parquet")
        shutil.copy(src, table / f"part-{i}.parquet")

    add(0), add(1), add(2)
    base = str(tmp_path / "stream")
    learner.stream_deltas(spark, str(tmp_path), actions_table(spark), "events.parquet", base, 1)
    first = spark.read.parquet(base + "/deltas").count()
    add(3)
    out, _ = learner.stream_deltas(spark, str(tmp_path), actions_table(spark), "events.parquet", base, 1)
    items, _ = learner.counts_from_deltas(spark.read.parquet(out))
    assert 0 < first < spark.read.parquet(out).count()
    from affinis.plans.queries import REGISTRY

    want = REGISTRY["item_counts"](spark, "/root/testdata/sf0.001")
    assert {tuple(r) for r in items.collect()} == {tuple(r) for r in want.collect()}
