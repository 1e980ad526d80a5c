"""Operator 9: vector best-fit packing of documents into sequences.

Every sequence has three capacities: tokens, documents and attention cost (the
sum of squared piece lengths, what full attention inside each piece costs).  A
piece goes only where all three hold.  Documents longer than a sequence are cut
into full pieces and a rest; nothing else is cut.

Pieces are dealt by hash into groups of about ``group_sequences`` sequences, so
the number of groups follows the tokens and a group's size does not: equal
pieces are counted and dealt in lots of ``COPIES``.  Every group is packed by one task, and only its last sequences can stay unfilled on
its account.  Within a group the pieces go in descending length (ties by
doc_id, piece, checksum: the result does not depend on the order of rows).

Null and empty texts are one piece with the end id; repeated rows are packed
each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import arrow_schema, fanout_partitions, written
from affinis.llm.tokenizing import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long"

#: Equal pieces that go to one group together.
COPIES = 64


@dataclass(frozen=True)
class Capacity:
    """Of one sequence.  The defaults of ``documents`` and ``attention`` are
    what ``tokens`` already implies, so they bind only when set lower."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"  # or "dot"


def pieces(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, tokens: int = 4096,
           key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts, append ``end_id``, cut at every ``tokens`` ids.
    ``with_ids`` adds the ids themselves (array<int>)."""
    schema = PIECE + (", ids array<int>" if with_ids else "")
    arrow = arrow_schema(docs.sparkSession, schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                out: list[list] = [[] for _ in arrow]
                for doc, body in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    ids = enc.encode(body) + end
                    for k, start in enumerate(range(0, len(ids), 4 * tokens)):
                        part = ids[start:start + 4 * tokens]
                        for c, v in zip(out, (doc, k, start // 4, len(part) // 4, zlib.crc32(part)), strict=False):
                            c.append(v)
                        if with_ids:
                            out[5].append(np.frombuffer(part, "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, cap: Capacity) -> np.ndarray:
    """Bin of each piece, in the given order (descending lengths); bins from 0.

    ``norm``: a piece goes to the open bin whose weighted residual vector is
    shortest after it, among those where all capacities hold.  ``dot``: bins are
    filled one at a time with the piece that fits and has the largest weighted
    dot product with the bin's residual vector.
    """
    full = np.array([cap.tokens, cap.documents, cap.attention], np.float64)
    weight = np.array(cap.weights, np.float64)
    lengths = lengths.astype(np.float64)
    if lengths.size and (lengths.max() > cap.tokens or lengths.max() ** 2 > cap.attention or cap.documents < 1):
        raise ValueError("a single piece exceeds the capacities of a sequence")
    if cap.rule == "dot":
        return _by_dot(lengths, full, weight)
    if cap.rule != "norm":
        raise ValueError(f"unknown rule {cap.rule}")
    out = np.empty(lengths.size, np.int64)
    names = np.empty(lengths.size, np.int64)  # of the open bins
    left = np.empty((3, lengths.size), np.float64)
    n_open = made = 0
    least = lengths.min() if lengths.size else 0
    for i, length in enumerate(lengths):
        need = np.array([length, 1.0, length * length])
        best = -1
        if n_open:
            now = left[:, :n_open]
            fits = np.flatnonzero((now[0] >= need[0]) & (now[1] >= 1) & (now[2] >= need[2]))
            if fits.size:
                rest = (now[:, fits] - need[:, None]) / full[:, None]
                best = int(fits[np.argmin(weight @ (rest * rest))])
        if best < 0:
            best, names[n_open], left[:, n_open] = n_open, made, full
            n_open, made = n_open + 1, made + 1
        left[:, best] -= need
        out[i] = names[best]
        if left[0, best] < least or left[1, best] < 1 or left[2, best] < least * least:
            n_open -= 1  # closed: the last open bin takes its place
            names[best], left[:, best] = names[n_open], left[:, n_open]
    return out


def _by_dot(lengths: np.ndarray, full: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.full(lengths.size, -1, np.int64)
    need = np.stack([lengths, np.ones_like(lengths), lengths * lengths])
    waiting, made = np.arange(lengths.size), 0
    while waiting.size:
        left, taken = full.copy(), np.zeros(waiting.size, bool)
        while True:
            fits = np.flatnonzero(~taken & (need[:, waiting] <= left[:, None]).all(axis=0))
            if not fits.size:
                break
            score = (weight * left / full / full) @ need[:, waiting[fits]]
            pick = fits[np.argmax(score)]
            taken[pick] = True
            left -= need[:, waiting[pick]]
            out[waiting[pick]] = made
        waiting, made = waiting[~taken], made + 1
    return out


def place(parts: DataFrame, cap: Capacity = Capacity(), group_sequences: int = 2048) -> DataFrame:
    """``sequence_id`` and ``offset`` for every piece (columns of PIECE)."""
    total = parts.agg(F.sum("length").alias("n"), F.count("*").alias("m")).first()
    by = max((total.n or 0) / cap.tokens, (total.m or 0) / cap.documents / 4, (total.m or 0) / 65536)
    groups = max(1, round(by / group_sequences))
    arrow = arrow_schema(parts.sparkSession, PLACED)
    names = [f.name for f in arrow]

    def pack_group(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.repeat(np.arange(table.num_rows), table.column("copies").to_numpy())))
        cols = {c: table.column(c).to_pandas().to_numpy() for c in ("length", "piece", "ids_crc32")}
        doc = table.column("doc_id").to_pandas().fillna(-1).to_numpy()
        order = np.lexsort((cols["ids_crc32"], cols["piece"], doc, -cols["length"]))
        length = cols["length"][order]
        bins = best_fit(length, cap)
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[by_bin])
        firsts = np.r_[True, np.diff(bins[by_bin]) != 0] if length.size else np.zeros(0, bool)
        base = np.maximum.accumulate(np.where(firsts, ends - length[by_bin], 0))
        rows = table.take(pa.array(order[by_bin]))
        return pa.Table.from_arrays(
            [rows.column(c) for c in names[:5]]
            + [pa.array(key[0].as_py() * (1 << 32) + bins[by_bin]), pa.array(ends - length[by_bin] - base)],
            schema=arrow)

    counted = parts.groupBy(*names[:5]).agg(F.count("*").alias("n"))
    lots = counted.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("int"))))
    grouped = lots.select(*names[:5], F.least(F.lit(COPIES), F.col("n") - F.col("lot") * COPIES).alias("copies"),
                          F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "lot"), F.lit(groups)).alias("g"))
    return (grouped.repartition(max(1, min(groups, fanout_partitions(parts.sparkSession))), "g")
            .groupBy("g").applyInArrow(pack_group, PLACED))


def sequences(placed: DataFrame, parts_with_ids: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, piece_lengths (in
    offset order, for an attention mask that keeps pieces apart)."""
    keys = ["doc_id", "piece", "ids_crc32"]
    own = parts_with_ids.select(*(F.col(k).alias(f"_{k}") for k in keys), "ids").dropDuplicates([f"_{k}" for k in keys])
    joined = placed.join(own, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("piece") == F.col("_piece"))
                         & (F.col("ids_crc32") == F.col("_ids_crc32")))
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (joined.groupBy("sequence_id").agg(ordered.alias("p"))
            .select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("piece_lengths")))


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1,
                   cap: Capacity = Capacity()) -> DataFrame:
    """All documents, cut into pieces and placed."""
    return place(written(pieces(docs, tokenizer, kind, end_id, cap.tokens), "pieces"), cap)
