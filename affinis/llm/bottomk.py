"""Operator 12: near duplicates by bottom-k sketches from one hash function.

A document's set is that of its distinct five-word shingles; a shingle's value
is its XXH64.  The sketch keeps the smallest values of a set.

* Equal sets are one class from the start; classes are compared once.
* The ``LISTED`` = 16 smallest values have inverted lists.  Two sets of Jaccard
  0.85 have ``SHARED`` = 4 or more of the 16 smallest values of their union in
  both, but for one pair in 10^8 (binomial tail 7e-9; more similar pairs are
  safer, and sets of at most 13 shingles are sure).  So these values, in one
  order for all, hold a common one among the first 16 - 4 + 1.  The order is
  rarest first: a passage that many documents hold comes last, and values that
  no other document retains need no list at all.
* Rows of a list carry the ``K`` = 512 smallest values, the upper half of each.
  The union sketch of two documents (the 512 smallest of both) estimates the
  overlap: at Jaccard 0.85 at least ``NEED`` = 387 of them are in both, but for
  one pair in 10^8.  Sets of at most 512 shingles are whole in their sketch, so
  that hardly a candidate fails later.
* Candidates are verified on the full sets: 100 x intersection >= 85 x union.

Lists are cut into blocks of about ``BLOCK`` rows, within which a matrix product
of values held counts the overlaps of many pairs at once.  Lists of near copies
are long, and their members would be all pairs.  Three rounds avoid that without
losing a link: first only neighbours in the order of their sketches are
candidates; then, between what is not connected yet, as many candidates as
connect it, the closest first; last, every candidate whose ends are still in
different components.  What is in one component already needs no further link.

Null and empty texts have an empty set and link with nothing; each is its own
component.  Under five words, the whole sequence is one shingle.  Equal rows
share their component; a component's id is the smallest id in it, nulls aside
(null if there is no other).  An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import LOWER_BYTES, arrow_schema, fanout_partitions, utf8, written
from affinis.llm.simhash import connected

WORDS, SEED, PERCENT = 5, 42, 85
LISTED, SHARED = 16, 4
RETAINED, HELD = 32, 13
K, NEED = 512, 387
BLOCK = 1024
#: Classes in lists whose keys may be broadcast (16 bytes each).
BROADCAST_NODES = 2_000_000
_PAIRS = 1 << 12  # compared at a time
_TOP = np.uint64(1 << 63)
_PAD = np.int64(1 << 40)  # above every upper half


def shingle_values(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct values of a text's shingles."""
    from xxhash import xxh64_intdigest

    line = b" ".join(utf8(text).translate(LOWER_BYTES).split())
    if not line:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
    if len(gaps) < words:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(line)]
    return np.unique(np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[words - 1:], strict=False)],
                              np.uint64))


def _signed(values: np.ndarray) -> np.ndarray:
    """As longs in the same order."""
    return (values ^ _TOP).view(np.int64)


def _sets(docs: DataFrame, key: str, text: str, words: int, full: bool) -> DataFrame:
    """Per row: id, text hash, set size, node (hash of the set; null if empty)
    and its retained values, or with ``full`` the whole set."""
    from xxhash import xxh64_intdigest

    schema = "doc_id long, text_hash long, n long, node long, held array<bigint>"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_values(t.as_py(), words) for t in part.column(2)]
                nodes = [xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) if s.size else None for s in sets]
                kept = [_signed(s if full else s[:RETAINED]) for s in sets]
                ends = np.cumsum([0, *(k.size for k in kept)])
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(kept)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([s.size for s in sets], pa.int64()),
                     pa.array(nodes, pa.int64()), held.cast(arrow.field("held").type)], schema=arrow)

    body = F.col(text).cast("string")
    return docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(body).alias("h"), body.alias("t")).mapInArrow(run, schema)


def overlaps(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Union-sketch overlap of rows of two padded sketch matrices, or -1 where
    it rules the pair out.  Sets that the sketches hold whole are exact; equal
    upper halves of different values can only add to an overlap."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
    shared = twice.sum(axis=1)
    in_union = np.cumsum(~twice & (both != _PAD), axis=1) <= K
    found = (twice & in_union).sum(axis=1)
    whole = (na <= K) & (nb <= K)
    near = np.where(whole, 100 * shared >= percent * (na + nb - shared), found >= NEED)
    near &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    return np.where(near, np.where(whole, (K * shared) // np.maximum(na + nb - shared, 1), found), -1)


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of a row of ``a`` and one of ``b`` those whose count of
    common values allows a link: two index arrays.  The counts are a matrix
    product over the values that both sides hold, a stretch of them at a time."""
    values = np.intersect1d(a, b)
    values = values[values != _PAD]
    count = np.zeros((len(a), len(b)), np.float32)

    def held(m: np.ndarray, part: np.ndarray) -> np.ndarray:
        at = np.searchsorted(part, m).clip(max=part.size - 1)
        row, col = np.nonzero(part[at] == m)
        out = np.zeros((len(m), part.size), np.float32)
        np.add.at(out, (row, at[row, col]), 1.0)
        return out

    for start in range(0, values.size, 4096):
        part = values[start:start + 4096]
        count += held(a, part) @ held(b, part).T
    x, y = na[:, None].astype(np.int64), nb[None, :].astype(np.int64)
    sure = (x <= K) & (y <= K)
    near = np.where(sure, 100 * count >= percent * (x + y - count) - 1e-3, count >= NEED)
    return np.nonzero(near & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)))


def padded(column: pa.Array) -> np.ndarray:
    """A list column of sorted values as rows of K."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.full((len(sizes), K), _PAD)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _batched(batches: Iterable[pa.RecordBatch], keep: Callable) -> Iterator[dict]:
    """Sorted rows in runs of a few thousand; of each run, those that ``keep``
    picks come again with the next."""
    held = None
    for batch in (b.slice(at, 2048) for b in batches for at in range(0, b.num_rows, 2048)):
        now = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        now = {n: padded(c) if n == "held" else c.to_numpy(zero_copy_only=False) for n, c in now.items()}
        held = now if held is None else {n: np.concatenate([held[n], now[n]]) for n in now}
        if held["node"].size < 1 << 12:
            continue
        yield held
        again = keep(held)
        held = {n: c[again] for n, c in held.items()}
    if held is not None and held["node"].size:
        yield held


def _out(arrow: pa.Schema, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], schema=arrow)


class Forest:
    """What a task has connected: of the edges shown, those that connect more."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def connecting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        kept = []
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[x] = y
                kept.append(k)
        return np.array(kept, np.int64)


def neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v): candidates among rows next to each other in a list, ordered by sketch."""
    arrow = arrow_schema(rows.sparkSession, "u long, v long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for held in _batched(batches, lambda h: np.arange(h["node"].size) == h["node"].size - 1):
            at = np.flatnonzero((held["value"][1:] == held["value"][:-1]) & (held["node"][1:] != held["node"][:-1]))
            for part in (at[i:i + _PAIRS] for i in range(0, at.size, _PAIRS)):
                near = overlaps(held["held"][part], held["held"][part + 1], held["n"][part], held["n"][part + 1], percent) >= 0
                a, b = held["node"][part[near]], held["node"][part[near] + 1]
                new = forest.connecting(a, b)
                yield _out(arrow, a[new], b[new])

    spread = rows.select("value", "node", "n", "held").repartitionByRange(fanout_partitions(rows.sparkSession), "value", "held")
    return spread.sortWithinPartitions("value", "held").mapInArrow(run, "u long, v long").distinct()


def across(rows: DataFrame, percent: int, fewest: bool, block: int = BLOCK) -> DataFrame:
    """(u, v): candidates of a list with different ``label``; with ``fewest``,
    as many in a task as connect its labels."""
    spark = rows.sparkSession
    arrow = arrow_schema(spark, "u long, v long")
    per = rows.groupBy("value", "label").agg(F.count("*").alias("c"))
    lists = per.groupBy("value").agg(F.sum("c").alias("m"), F.count("*").alias("labels"), F.max_by("label", "c").alias("major"))
    lists = lists.where("labels > 1").select("value", "major", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    # every row is a guest in one block; rows outside the largest component visit all
    dealt = rows.join(lists, "value").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    visits = F.when(F.col("label") == F.col("major"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("block", F.explode(visits)).select(
        "value", "block", (F.col("block") == F.col("own")).alias("guest"), (F.col("label") != F.col("major")).alias("host"),
        "node", "n", "label", "held")

    def linked(held: dict, row: np.ndarray, col: np.ndarray, forest: Forest | None) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows those that the filter passes."""
        apart = held["label"][row] != held["label"][col]
        apart &= 100 * np.minimum(held["n"][row], held["n"][col]) >= percent * np.maximum(held["n"][row], held["n"][col])
        row, col = row[apart], col[apart]
        score = np.concatenate([np.zeros(0, np.int64), *(
            overlaps(held["held"][row[i:i + _PAIRS]], held["held"][col[i:i + _PAIRS]], held["n"][row[i:i + _PAIRS]],
                     held["n"][col[i:i + _PAIRS]], percent) for i in range(0, row.size, _PAIRS))])
        row, col, score = row[score >= 0], col[score >= 0], score[score >= 0]
        if forest is not None:
            order = np.argsort(-score, kind="stable")
            order = order[forest.connecting(held["label"][row[order]], held["label"][col[order]])]
            row, col = row[order], col[order]
        return held["node"][row], held["node"][col]

    def compare(held: dict, forest: Forest | None) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.r_[0, (held["value"][1:] != held["value"][:-1]) | (held["block"][1:] != held["block"][:-1])])
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        guests = np.add.reduceat(held["guest"].astype(np.int64), first)
        hosts = np.flatnonzero(held["host"] & ~held["met"])
        many = guests[group[hosts]] >= 64
        few = hosts[~many]
        start, width = first[group[few]], guests[group[few]]  # short lists: pair by pair
        ends = np.cumsum(width)
        at = 0
        while at < few.size:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + 16 * _PAIRS, "right")))
            w = width[at:to]
            row = np.repeat(few[at:to], w)
            col = np.repeat(start[at:to] - (ends[at:to] - w), w) + np.arange(done, done + w.sum())
            yield _out(arrow, *linked(held, row, col, forest))
            at = to
        for g in np.unique(group[hosts[many]]):  # long ones: by matrix products
            there = np.arange(first[g], first[g] + guests[g])
            own = hosts[many][group[hosts[many]] == g]
            for part in (own[i:i + 256] for i in range(0, own.size, 256)):
                x, y = possible(held["held"][part], held["held"][there], held["n"][part], held["n"][there], percent)
                yield _out(arrow, *linked(held, part[x], there[y], forest))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keep(held):  # of the last block, the guests: more hosts may follow
            held["met"][:] = True
            return (held["value"] == held["value"][-1]) & (held["block"] == held["block"][-1]) & held["guest"]

        forest = Forest() if fewest else None
        for held in _batched(batches, keep):
            yield from compare(held, forest)

    n = fanout_partitions(spark)
    ordered = dealt.withColumn("met", F.lit(False)).repartition(n, "value", "block").sortWithinPartitions(
        "value", "block", F.desc("guest"), "node")
    return ordered.mapInArrow(run, "u long, v long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("u"), F.col("held").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("held").alias("b"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", F.size(F.array_intersect("a", "b")).cast("long").alias("i"),
                                                  (F.size("a") + F.size("b")).cast("long").alias("s"))
    return both.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("u", "v")


def list_rows(classes: DataFrame) -> DataFrame:
    """(value, node): the inverted lists of two rows or more.  Per class the
    listed values that other classes hold, rarest first, as far as the prefix goes."""
    each = classes.select("node", F.posexplode("held").alias("place", "value"))
    shared = each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    per = each.join(shared, "value").groupBy("node").agg(
        F.count("*").alias("n_common"),
        F.array_sort(F.collect_list(F.when(F.col("place") < LISTED, F.struct("df", "value")))).alias("common"))

    def least(of: int, many: int) -> Column:  # common values that a near set's smallest must have
        return F.when(F.col("n") <= int(0.85 * of), F.ceil(F.col("n") * 0.85)).otherwise(many)

    size = F.least(F.size("held"), F.lit(LISTED))
    first = (size - least(LISTED, SHARED) + 1) - (size - F.size("common"))  # values that no other class holds come first
    lists = classes.join(per, "node").where(F.col("n_common") >= least(RETAINED, HELD)).withColumn("first", first.cast("int"))
    lists = lists.where("first > 0").select("node", F.explode(F.slice("common", 1, F.col("first"))).alias("c"))
    lists = lists.select(F.col("c.value").alias("value"), "node")
    long_ = lists.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value")
    return lists.join(long_, "value")


def near_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    if percent < PERCENT:
        raise ValueError(f"the sketches are sized for {PERCENT} hundredths or more")
    sketches = written(_sets(docs, key, text, words, full=False), "sketches")
    filled = sketches.where("node IS NOT NULL")
    classes = written(filled.groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("text_hash", "doc_id")).alias("one"), F.first("n").alias("n"),
        F.first("held").alias("held")), "sketch-classes")
    lists = written(list_rows(classes), "sketch-lists")
    # full sets of the classes in a list only, from one document each
    needed = written(lists.select("node").distinct().join(classes, "node").select(
        F.col("one.text_hash").alias("_h"), F.col("one.doc_id").alias("_k")), "sketch-needed")
    few = needed.count() <= BROADCAST_NODES
    body = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    body = body.join(F.broadcast(needed) if few else needed,
                     (F.xxhash64("t") == F.col("_h")) & F.col("k").eqNullSafe(F.col("_k")), "left_semi")
    sets = written(_sets(body, "k", "t", words, full=True).groupBy("node").agg(F.first("held").alias("held")), "shingle-sets")

    upper = F.transform(F.slice("held", 1, K), lambda v: F.shiftright(v, 32))
    rows = lists.join(sets.select("node", F.size("held").cast("long").alias("n"), upper.cast("array<int>").alias("held")), "node")
    links = written(verified(neighbours(rows, percent), sets, percent), "near-links")
    tree = written(connected(links), "near-trees")
    for fewest in (True, False):
        labels = tree.union(tree.select(F.col("root").alias("node"), "root").distinct())
        labelled = rows.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        more = written(verified(across(labelled, percent, fewest), sets, percent), "near-links")
        if more.isEmpty():
            continue
        ends = more.join(labels.select(F.col("node").alias("u"), F.col("root").alias("x")), "u", "left").join(
            labels.select(F.col("node").alias("v"), F.col("root").alias("y")), "v", "left")
        x, y = F.coalesce("x", "u"), F.coalesce("y", "v")
        top = written(connected(ends.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()), "near-trees")
        moved = tree.join(top.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left")
        tree = written(moved.select("node", F.coalesce("further", "root").alias("root")).union(top), "near-trees")
    tied = tree.union(tree.select(F.col("root").alias("node"), "root").distinct())
    grouped = classes.select("node", "least").join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    final = written(grouped.join(least, "root").select("node", "component_id"), "near-classes")
    joined = filled.select("doc_id", "n", "node").join(final, "node").select("doc_id", "n", "component_id")
    alone = sketches.where("node IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return joined.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
