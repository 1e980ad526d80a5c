"""Operator 6: SimHash near duplicates through a covering code.

A text's fingerprint has 64 bits: bit b is 1 if over half of its shingles'
XXH64 hashes have it.  Fingerprints link at ``DISTANCE`` = 4 or fewer differing
bits, and a component is what links reach.

Links are found around anchor points.  The 64 bits are three segments of 22, 22
and 20 bits.  Of two fingerprints that differ in at most 4 bits, one of these
holds: the first segments differ in at most 1 bit, the second ones do, or the
third ones are equal (2 + 2 + 1 differences would be 5).  In the first two
segments the anchors are the words of a covering code: the [15,11] Hamming code
on 15 bits, each of whose 2^15 words lies within radius 1 of exactly one
codeword, and all 2^7 words of the other 7 bits.  A fingerprint's home is the
anchor nearest to it, and it is replicated to every anchor that can be the home
of a fingerprint within the segment's threshold, which lie within radius plus
threshold: 15 on average, of 2^18.  The third segment's anchors are its 2^20
words.  Every two linked fingerprints meet at an anchor that is the home of one
of them; only homes are compared with the rest there.

An anchor's rows come sorted, homes first, and are compared in numpy blocks of
bounded size.  Only a spanning forest of the links found leaves the task, so a
large group of near copies costs rows in proportion to its size, not its
square.  Anchors with over ``HOMES`` homes are split by home into cells.

Equal fingerprints are one class from the start.  Null and empty texts have the
fingerprint zero and link like any other.  Equal rows share their component; a
row with a null id takes part, its class's smallest id being of the others
(null if there is none).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import LOWER_BYTES, arrow_schema, fanout_partitions, map_rows, utf8, written

SEED, WORDS, DISTANCE = 42, 4, 4
HOMES = 4096  # of one cell
_PAIRS = 1 << 21  # compared at a time
_SEGMENTS = ((0, 22), (22, 22), (44, 20))  # first bit, bits


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    from xxhash import xxh64_intdigest

    line = b" ".join(utf8(text).translate(LOWER_BYTES).split())
    if not line:
        return 0
    gaps = [i for i, b in enumerate(line) if b == 32] if len(line) < 64 else np.flatnonzero(
        np.frombuffer(line, np.uint8) == 32).tolist()
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(line)]
    if len(starts) > words:
        hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[words - 1:], strict=False)],
                          "<u8")
    else:
        hashes = np.array([xxh64_intdigest(line, seed)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = np.unpackbits(hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += block.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, fp): XXH64 of the text, its fingerprint as a signed long."""

    def rows(batch: dict) -> dict:
        fps = np.array([fingerprint(t, words) for t in batch["t"]], np.uint64).view(np.int64)
        return {"doc_id": batch["k"], "text_hash": batch["h"], "fp": fps}

    body = F.col(text).cast("string")
    picked = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(body).alias("h"), body.alias("t"))
    return map_rows(picked, rows, "doc_id long, text_hash long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of the low 15 bits in the Hamming code whose column j is j + 1: 0 for a
    codeword, else 1 plus the place of the bit that leads to one."""
    out = np.zeros_like(x)
    for place in range(15):
        out ^= ((x >> np.uint64(place)) & np.uint64(1)) * np.uint64(place + 1)
    return out


def home(x: np.ndarray) -> np.ndarray:
    """The anchor nearest to 22-bit words: their 15-bit part's codeword, the
    other 7 bits as they are."""
    s = _syndrome(x)
    return np.where(s == 0, x, x ^ (np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1))))


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor key, is home) of every replica of unsigned fingerprints."""
    rows, keys, homes = [], [], []
    every = np.arange(fps.size)
    for seg, (low, bits) in enumerate(_SEGMENTS):
        part = (fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        tag = np.uint64(seg << 32)
        if seg == 2:
            rows.append(every), keys.append(part | tag), homes.append(np.ones(fps.size, bool))
            continue
        around = np.stack([home(part), *(home(part ^ np.uint64(1 << b)) for b in range(bits))], axis=1)
        own = around[:, :1]
        other = np.sort(np.where(around == own, own, around), axis=1)
        new = np.ones(other.shape, bool)
        new[:, 1:] = other[:, 1:] != other[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r), keys.append(other[r, c] | tag), homes.append(other[r, c] == own[r, 0])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n nodes over edges (a, b), and
    over the stars already in ``label``."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up


def cell_links(group: np.ndarray, fp: np.ndarray, is_home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of sorted cells: rows of a group stand
    together, homes first.  Returns linked fingerprints (node, root)."""
    n = fp.size
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    n_homes = np.add.reduceat(is_home.astype(np.int64), first)
    size = np.diff(np.r_[first, n])
    start, width = np.repeat(first, size), np.repeat(n_homes, size)
    width = np.minimum(width, np.arange(n) - start)  # a home meets the homes before it
    label = np.arange(n)
    ends = np.cumsum(width)
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
        w = width[at:to]
        row = np.repeat(np.arange(at, to), w)
        col = np.repeat(start[at:to] - (ends[at:to] - w), w) + np.arange(done, done + w.sum())
        near = np.bitwise_count(fp[row] ^ fp[col]) <= distance
        label = components(n, row[near], col[near], label)
        at = to
    linked = np.flatnonzero((label != np.arange(n)) & (fp != fp[label]))
    return fp[linked], fp[label[linked]]


def links(fps: DataFrame, distance: int = DISTANCE, homes_per_cell: int = HOMES) -> DataFrame:
    """Distinct links (u, v) that connect what lies within ``distance``.
    ``fps``: distinct fingerprints in column fp, materialised."""
    if distance > DISTANCE:
        raise ValueError(f"the segments cover distances up to {DISTANCE}")
    spark = fps.sparkSession
    replica = "akey long, fp long, home boolean"
    arrow = arrow_schema(spark, replica)
    edge = arrow_schema(spark, "u long, v long")

    def replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                own = batch.column(0).slice(at, 1 << 14).to_numpy().view(np.uint64)
                row, key, is_home = anchors(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(own[row].view(np.int64)), pa.array(is_home)], schema=arrow)

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(),
                   batch.column(3).to_numpy(zero_copy_only=False)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if held[0].size < 1 << 16:
                continue
            yield compare(held)
            # of the last cell, homes stay: the rest of it follows
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            held = [x[last & held[3]] for x in held]
        if held is not None and held[0].size:
            yield compare(held)

    def compare(held: list[np.ndarray]) -> pa.RecordBatch:
        group = np.cumsum(np.r_[0, (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])])
        u, v = cell_links(group, held[2].view(np.uint64), held[3], distance)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=edge)

    rows = fps.select("fp").mapInArrow(replicate, replica)
    # anchors with many homes are dealt over cells: each home to one, the rest to all
    hot = (rows.where("home").groupBy("akey").count().where(F.col("count") > homes_per_cell)
           .select("akey", F.ceil(F.col("count") / homes_per_cell).cast("int").alias("cells")))
    dealt = rows.join(hot, "akey", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    celled = dealt.select("akey", "fp", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"),
                          (F.col("home") & (F.col("cells") == 1)).alias("alone"), "home", mine.alias("mine"))
    celled = celled.select("akey", "cell", "fp", (F.col("alone") | (F.col("home") & (F.col("mine") == F.col("cell"))))
                           .alias("home"))
    n = fanout_partitions(spark)
    ordered = celled.repartition(n, "akey", "cell").sortWithinPartitions("akey", "cell", F.desc("home"), "fp")
    pairs = ordered.mapInArrow(found, "u long, v long")
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component of edges (u > v), by
    alternating large and small stars; every round is written to the shared folder."""
    edges = written(edges, "edges")
    before = edges.count()
    for _ in range(rounds):
        if before == 0:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        last, edges = edges, written(small.where("u != v"), "edges")
        after = edges.count()
        if after == before and edges.join(last, ["u", "v"], "left_anti").isEmpty():
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    distance: int = DISTANCE, homes_per_cell: int = HOMES) -> DataFrame:
    """doc_id, text_hash, fp, component_id and root (the component's smallest
    fingerprint) for every row of ``docs``."""
    prints = written(fingerprints(docs, key, text, words), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    tree = written(connected(links(classes, distance, homes_per_cell)), "components")
    tied = tree.union(tree.select(F.col("root").alias("node"), "root").distinct()).distinct()
    grouped = tied.join(classes, F.col("node") == F.col("fp")).select("fp", "root", "rep")
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = grouped.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    final = classes.join(by_fp, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "rep").alias("component_id"))
    # written first: the join then has two plain sides, so that a hot fingerprint's rows can be split
    return prints.join(written(final, "class-components"), "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def hex_digits(fp: Column) -> Column:
    """Signed long to 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
