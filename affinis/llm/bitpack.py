"""Operator 7: token ids in files of fixed-width bits.

A file holds the ids of some documents, one after the other, each id in the
fewest bits that hold the vocabulary.  Ids are cut into blocks of
``BLOCK_IDS``; each block starts at a byte, and the footer lists the blocks'
byte offsets, so that any range of ids is read by seeking to its blocks and
unpacking them with numpy.

    "BPK1" | blocks ... | footer | footer length u64 | "BPK1"
    footer: bits u32, block ids u32, documents u64, ids u64, blocks u64,
            doc ids i64[documents], id starts u64[documents + 1], block offsets u64[blocks + 1]

Documents lie in ascending id order (null id first, equal ids by text), over
files that each hold one range of ids.  Null and empty texts hold the end id
alone; repeated rows are kept as they are; an empty table writes no file.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.common import arrow_schema, fanout_partitions, shared_scratch
from affinis.llm.tokenizing import encoder, vocabulary_size

MAGIC = b"BPK1"
BLOCK_IDS = 1 << 16
_HEAD = struct.Struct("<IIQQQ")
NO_ID = -(1 << 63)  # a null doc_id


def id_bits(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as one little-endian bit string, padded to whole bytes."""
    wide = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:  # whole bytes: the same string without taking bits apart
        return wide[:, :bits // 8].tobytes()
    return np.packbits(np.unpackbits(wide, axis=1, count=bits, bitorder="little").ravel(),
                       bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits % 8 == 0:
        whole = np.zeros((count, 4), np.uint8)
        whole[:, :bits // 8] = np.frombuffer(data, np.uint8, count * bits // 8).reshape(count, bits // 8)
        return whole.view("<u4").ravel()
    cells = np.unpackbits(np.frombuffer(data, np.uint8), count=bits * count, bitorder="little")
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = cells.reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Appends documents to an output stream; holds one block and 16 bytes a document."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.pending: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.docs: list[int] = []
        self.starts, self.offsets = [0], [len(MAGIC)]
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if ids.size and int(ids.max()) >> self.bits:
            raise ValueError(f"id {int(ids.max())} needs more than {self.bits} bits")
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.total += ids.size
        self.starts.append(self.total)
        self.pending.append(ids)
        self.waiting += ids.size
        if self.waiting >= self.block_ids:
            self._flush(self.waiting // self.block_ids * self.block_ids)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        for at in range(0, count, self.block_ids):
            data = pack(ids[at:min(count, at + self.block_ids)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.pending, self.waiting = [ids[count:]], self.waiting - count

    def close(self) -> None:
        if self.waiting:
            self._flush(self.waiting)
        footer = _HEAD.pack(self.bits, self.block_ids, len(self.docs), self.total, len(self.offsets) - 1)
        footer += np.array(self.docs, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes()
        footer += np.array(self.offsets, "<u8").tobytes()
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class Reader:
    """Random access to one file: ``ids(a, b)`` reads only the blocks that hold them."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 12)
        tail = file.read(12)
        if tail[8:] != MAGIC:
            raise ValueError("not a packed id file, or cut short")
        length = struct.unpack("<Q", tail[:8])[0]
        file.seek(size - 12 - length)
        foot = file.read(length)
        self.bits, self.block_ids, n, self.total, blocks = _HEAD.unpack_from(foot)
        at = _HEAD.size
        self.docs = np.frombuffer(foot, "<i8", n, at)
        self.starts = np.frombuffer(foot, "<u8", n + 1, at + 8 * n).astype(np.int64)
        self.offsets = np.frombuffer(foot, "<u8", blocks + 1, at + 8 * (2 * n + 1)).astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block_ids, (b - 1) // self.block_ids
        self.file.seek(int(self.offsets[first]))
        out = []
        for k in range(first, last + 1):
            count = min(self.block_ids, self.total - k * self.block_ids)
            out.append(unpack(self.file.read(int(self.offsets[k + 1] - self.offsets[k])), self.bits, count))
        return np.concatenate(out)[a - first * self.block_ids:b - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start in the file, ids) in file order, a few blocks at a time."""
        n, at = len(self.docs), 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + 4 * self.block_ids, "right")) - 1)
            base = int(self.starts[at])
            ids = self.ids(base, int(self.starts[to]))
            for k in range(at, to):
                yield (None if self.docs[k] == NO_ID else int(self.docs[k]), int(self.starts[k]),
                       ids[self.starts[k] - base:self.starts[k + 1] - base])
            at = to


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder that every executor reaches."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def write_files(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte",
                end_id: int | None = None, key: str = "doc_id", text: str = "text",
                block_ids: int = BLOCK_IDS, files: int | None = None) -> DataFrame:
    """Encode and write ``docs`` into ``folder``, one file for each range of ids;
    returns the manifest (one row a file: path, first_doc, n_docs, n_ids).

    A task writes under a name of its own and renames the file when it is
    whole, so a repeated or speculative attempt leaves the same file.  Other
    columns of ``docs`` are not read.
    """
    bits = id_bits(max(vocabulary_size(tokenizer), (end_id or 0) + 1))
    schema = "path string, first_doc long, n_docs long, n_ids long"
    arrow = arrow_schema(docs.sparkSession, schema)
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer, kind)
        store, root = file_system(folder)
        task = TaskContext.get()
        name = f"{root}/ids-{task.partitionId():06d}"
        writer = out = None
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp")
                    writer = Writer(out, bits, block_ids)
                ids = np.frombuffer(enc.encode(body.as_py()), "<u4")
                writer.add(doc, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            out.close()
            store.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.bpk")
            first = None if writer.docs[0] == NO_ID else writer.docs[0]
            yield pa.RecordBatch.from_pylist(
                [{"path": f"{name}.bpk", "first_doc": first, "n_docs": len(writer.docs), "n_ids": writer.total}],
                schema=arrow)

    n = files or fanout_partitions(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.repartitionByRange(n, "k").sortWithinPartitions("k", "t").mapInArrow(run, schema)


def read_files(spark: SparkSession, folder: str, manifest: DataFrame, columns: str, row) -> DataFrame:
    """Read every file of a manifest, one task a file: ``row(doc, start, ids)``
    gives one result row; ``start`` counts the ids of all earlier documents.

    The driver holds one line for each file, never for each document.
    """
    lines = sorted(manifest.collect(), key=lambda r: (r.first_doc is not None, r.first_doc or 0, r.path))
    before, todo = 0, []
    for r in lines:
        todo.append((r.path, before))
        before += r.n_ids
    names = [c.split()[0] for c in columns.split(", ")]
    arrow = arrow_schema(spark, columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        for batch in batches:
            for line in batch.to_pylist():
                out: list[tuple] = []
                with store.open_input_file(line["path"]) as f:
                    for doc, start, ids in Reader(f, f.size()).documents():
                        out.append(row(doc, line["before"] + start, ids))
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, arrow.field(k).type) for k, c in zip(names, zip(*out, strict=True), strict=True)],
                                schema=arrow)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, arrow.field(k).type) for k, c in zip(names, zip(*out, strict=True), strict=True)],
                        schema=arrow)

    if not todo:
        return spark.createDataFrame([], columns)
    files = spark.createDataFrame(todo, "path string, before long").repartition(len(todo))
    return files.mapInArrow(run, columns)


def packed_ids(docs: DataFrame, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """Write the files and return, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = shared_scratch(spark, "packed-ids")
    written = write_files(docs, folder, tokenizer, kind, end_id)
    manifest = os.path.join(folder, "manifest")
    written.write.parquet(manifest)
    return read_files(spark, folder, spark.read.parquet(manifest),
                      "doc_id long, start long, n_tokens long, ids_crc32 long",
                      lambda doc, start, ids: (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))


__all__ = ["Reader", "Writer", "id_bits", "pack", "packed_ids", "read_files", "unpack", "write_files"]
