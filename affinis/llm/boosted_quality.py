"""Operator 4: quality classifier of boosted histogram trees.

A document's statistics (character classes, words, lines, repetition; no label,
language, source or id) come from one pass over whole texts.  Trees are grown
on a sample of at most ``MAX_TRAIN`` labelled rows, the ones with the smallest
hash of their id; everything else covers all rows.  A model is five flat
arrays, and scoring walks all rows of a batch down all trees at once in numpy.

* Rows train only if ``may_train`` allows their id; several labels of one id count as the largest; null labels are no label.
* Null and empty texts have statistics zero and get a score like any other.
* Without labels, or with one class only, the score is the labels' mean (0.5 without any).
* Equal texts get equal scores; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import map_rows, smallest_hashes, utf8, written

#: Bound of the training sample; about 100 bytes a row on the driver.
MAX_TRAIN = 40_000

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "upper", "lower", "digit", "space", "newline", "punct", "symbol", "high",
    "control", "mean_word", "long_word", "distinct_words", "top_word", "distinct_lines", "mean_line",
    "bang", "pipe", "dollar", "percent", "hash", "star", "amp", "quote", "bracket", "comma", "period", "upper_words",
    "byte_entropy",
)

_CLASS = {name: np.isin(np.arange(256), list(members)) for name, members in {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "space": b" ",
    "newline": b"\n", "punct": b".,;:!?'\"()-", "symbol": b"#*$%&|<>@^~_=+\\/{}[]`", "high": range(0x80, 0x100),
    "control": [*range(0x09), *range(0x0B, 0x20), 0x7F], "bang": b"!", "pipe": b"|", "dollar": b"$", "percent": b"%",
    "hash": b"#", "star": b"*", "amp": b"&", "quote": b"'\"", "bracket": b"()[]{}<>", "comma": b",", "period": b".",
}.items()}


def statistics(text: str | None) -> list[float]:
    """The figures of STATISTICS for one text; shares are of its bytes, words or lines."""
    data = utf8(text)
    if not data:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = {name: counts[cells].sum() / len(data) for name, cells in _CLASS.items()}
    words = data.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = counts[counts > 0] / len(data)
    rest = {
        "log_bytes": np.log1p(len(data)), "log_words": np.log1p(len(words)), "log_lines": np.log1p(len(lines)),
        "mean_word": lengths.mean() if len(words) else 0.0, "long_word": (lengths > 15).sum() / n,
        "distinct_words": len(seen) / n, "top_word": max(seen.values(), default=0) / n,
        "distinct_lines": len(set(lines)) / max(1, len(lines)), "mean_line": len(words) / max(1, len(lines)),
        "upper_words": sum(map(bytes.isupper, words)) / n, "byte_entropy": -(p * np.log2(p)).sum(),
    }
    return [float(share[c] if c in share else rest[c]) for c in STATISTICS]


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): x holds the statistics."""
    picked = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return map_rows(picked, lambda b: {"doc_id": b["k"], "x": [statistics(t) for t in b["t"]]},
                    "doc_id long, x array<float>")


@dataclass
class Trees:
    """All trees' nodes one after the other.  A leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for at in range(0, len(x), 4096):
            part = x[at:at + 4096]
            node = np.repeat(self.roots[None, :], len(part), axis=0)
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                goes_left = part[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            out[at:at + 4096] += self.value[node].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
         least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boost logistic loss on histograms of gradients.  Same rows, same trees."""
    x = np.asarray(x, np.float32)
    mean = float(np.mean(y)) if len(y) else 0.5
    empty = Trees(*(np.zeros(0, t) for t in (np.int32, np.float32, np.int32, np.int32, np.float64, np.int64)),
                  float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1))), 0)
    if len(y) == 0 or mean in (0.0, 1.0):
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32))
             for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])  # x <= edge: bin <= its place
    margin = np.full(len(y), empty.base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        level = [(roots[-1], np.arange(len(y)))]
        for d in range(depth + 1):
            below = []
            for node, rows in level:
                split = d < depth and _best_split(binned[:, rows], g[rows], h[rows], bins, least, ridge)
                if not split:
                    nodes[node][4] = value = -rate * g[rows].sum() / (h[rows].sum() + ridge)
                    margin[rows] += value
                    continue
                f, b = split
                goes_left = binned[f, rows] <= b
                at = len(nodes)
                nodes[node][:4] = [f, float(edges[f][b]), at, at + 1]
                nodes += [[0, 0.0, at, at, 0.0], [0, 0.0, at + 1, at + 1, 0.0]]
                below += [(at, rows[goes_left]), (at + 1, rows[~goes_left])]
            level = below
    cols = list(zip(*nodes, strict=True))
    return Trees(np.array(cols[0], np.int32), np.array(cols[1], np.float32), np.array(cols[2], np.int32),
                 np.array(cols[3], np.int32), np.array(cols[4]), np.array(roots), empty.base, depth)


def _best_split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, least: float, ridge: float):
    """(feature, bin) with the largest gain, or None."""
    n_f = len(binned)
    cell = (binned + np.arange(n_f)[:, None] * bins).ravel()
    hist = [np.bincount(cell, np.tile(v, n_f), n_f * bins).reshape(n_f, bins).cumsum(axis=1) for v in (g, h)]
    gl, hl = hist[0][:, :-1], hist[1][:, :-1]
    gt, ht = g.sum(), h.sum()
    gr, hr = gt - gl, ht - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gt**2 / (ht + ridge)
    gain = np.where((hl * 4 >= least) & (hr * 4 >= least), gain, -np.inf)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(f), int(b)) if gain[f, b] > 1e-6 else None


def train(stats: DataFrame, labels: DataFrame, may_train: Column, label: str = "quality",
          max_train: int = MAX_TRAIN) -> Trees:
    """Trees from the labelled rows of (doc_id, x) that ``may_train`` (a
    condition on doc_id) allows."""
    marks = (labels.where(may_train & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y")))
    n = stats.select("doc_id").join(marks, "doc_id").count()
    marks = smallest_hashes(marks, "doc_id", max_train, n)
    sample = (stats.join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_train)
              .select("x", "y").toArrow())
    y = sample.column("y").to_numpy().astype(np.float64)
    x = sample.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(STATISTICS))
    return grow(x, y)


def score(stats: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) for every row of (doc_id, x)."""
    import pyarrow as pa

    from affinis.llm.common import arrow_schema

    arrow = arrow_schema(stats.sparkSession, "doc_id long, score double")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], schema=arrow)

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, may_train: Column, key: str = "doc_id",
                    text: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """Train on what the labels allow and score every row: doc_id, score."""
    stats = written(with_statistics(docs, key, text), "document-statistics")
    return score(stats, train(stats, labels, may_train, max_train=max_train))
