"""Operator 13: hard negatives through lists shared by clusters of anchors.

Anchors are clustered by direction (spherical k-means, fitted on at most
``FIT_ROWS`` of them, every one assigned).  For a cluster with centroid c whose
members lie within angle b of c, no member's inner product with a candidate x
exceeds |a| |x| cos(max(0, angle(c, x) - b)).  Candidates are sorted by that
bound once a cluster; every member walks the shared list, in blocks, until the
bound of the next block falls below what can still change its result.  The
walk is therefore exact.

Anchors are dealt in groups of about ``ANCHORS`` along the clusters and
candidates in segments of about ``CANDIDATES`` along theirs; a task holds one
group and one segment, whatever the size of a cluster or a label.  A first walk
finds the positives (the first rows of an anchor's label); their scores bound
the second one, whose negatives must lie in the band: a segment whose best
bound is below every band ends at once.  Tasks emit their best rows only, and
Spark ranks those.

Rows without an id, label or vector, or with a null or non-finite component,
take no part.  Shorter vectors count as ended by zeros.  Rows that repeat an id
are candidates each, but an anchor's positives are rows of other ids; equal
anchors count once.  Ties of score: the smaller id.  Components must be small
enough that a score fits a long.  An empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import arrow_schema, smallest_hashes, written

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256.0  # fixed values of the contract
FIT_ROWS, CLUSTERS, ITERATIONS = 20_000, 256, 8
ANCHORS, CANDIDATES, BLOCK = 2048, 8192, 256
_NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label, q (components as floor(256 x)) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.transform(x, lambda v: F.floor(F.lit(SCALE) * v).cast("long")).alias("q"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as integers, padded with zeros to ``d``."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def directions(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero stays zero) and norms."""
    norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    return q / np.where(norm > 0, norm, 1.0)[:, None], norm


def fit_centroids(unit: np.ndarray, n: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Spherical k-means from rows spread evenly over the sample."""
    if not len(unit) or not unit.shape[1]:
        return np.zeros((1, unit.shape[1]))
    centres = unit[np.linspace(0, len(unit) - 1, min(n, len(unit))).astype(int)].copy()
    for _ in range(iterations):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.sqrt((sums ** 2).sum(axis=1))
        centres = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1.0)[:, None], centres)
    return centres


def bounds(centre: np.ndarray, members: np.ndarray, items: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Most that the inner product with a member's unit vector can be, per item:
    the members lie within the widest angle to the centre."""
    if not np.abs(centre).sum():
        return norms.copy()
    wide = np.arccos(np.clip(members @ centre, -1, 1)).max()
    away = np.arccos(np.clip(items @ centre, -1, 1))
    return norms * np.cos(np.maximum(0.0, away - wide - 1e-7))


class Best:
    """The k first (score, id) per row: scores descending, ids ascending."""

    def __init__(self, rows: int, k: int):
        self.score, self.id = np.full((rows, k), _NONE), np.full((rows, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """Scores (rows, b) of candidates ``ids`` (b); invalid ones are passed over."""
        k = self.score.shape[1]
        new = (valid & (score >= self.score[rows, -1:])).any(axis=1)
        rows, score, valid = rows[new], score[new], valid[new]
        if not rows.size:
            return
        s = np.concatenate([self.score[rows], np.where(valid, score, _NONE)], axis=1)
        i = np.concatenate([self.id[rows], np.where(valid, ids[None, :], np.iinfo(np.int64).max)], axis=1)
        order = np.argsort(i, axis=1, kind="stable")
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        order = np.argsort(~s, axis=1, kind="stable")[:, :k]  # ~s descends and cannot overflow
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def walk(a: np.ndarray, x: np.ndarray, centres: np.ndarray, own: np.ndarray, floor, meet, block: int = BLOCK) -> int:
    """Every anchor (row of ``a``) walks its cluster's list of the candidates
    ``x``.  ``floor(rows)``: a score below it changes nothing any more;
    ``meet(rows, candidates, scores)`` takes a block's scores.  Returns the
    number of scores computed."""
    (ua, na), (ux, nx) = directions(a), directions(x)
    top = max(int(np.abs(a).max(initial=0)), 1) * max(int(np.abs(x).max(initial=0)), 1) * max(a.shape[1], 1)
    exact = np.float64 if top < 2 ** 52 else np.int64
    aa, xx, met = a.astype(exact), x.astype(exact), 0
    for c in np.unique(own):
        members = np.flatnonzero(own == c)
        bound = bounds(centres[c], ua[members], ux, nx)
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        for at in range(0, len(order), block):
            most = na[members] * (bound[at] * (1 + 1e-9)) + 1e-3 if bound[at] > 0 else na[members] * (bound[at] * (1 - 1e-9)) + 1e-3
            members = members[most >= floor(members)]
            if not members.size:
                break
            part = order[at:at + block]
            met += members.size * part.size
            meet(members, part, (aa[members] @ xx[part].T).astype(np.int64))
    return met


def _cell_positives(k: int):
    def run(anchors: dict, items: dict, centres: np.ndarray) -> dict:
        best = Best(len(anchors["id"]), k)

        def meet(rows, part, score):
            fits = (anchors["label"][rows][:, None] == items["label"][part]) & (anchors["id"][rows][:, None] != items["id"][part])
            best.add(rows, score, items["id"][part], fits)

        walk(anchors["q"], items["q"], centres, anchors["cluster"], lambda rows: best.score[rows, -1], meet)
        row, col = np.nonzero(best.score != _NONE)
        return {"aid": anchors["aid"][row], "other": best.id[row, col], "score": best.score[row, col]}

    return run


def _cell_negatives(k: int, low: int, high: int):
    def run(anchors: dict, items: dict, centres: np.ndarray) -> dict:
        bands = anchors["bands"]  # (anchors, positives) scores, _NONE where there is none
        there, lists = bands != _NONE, [Best(len(bands), k) for _ in range(bands.shape[1])]
        safe = np.where(there, bands, 0)
        # 100 s >= low p: the smallest integer s is the ceiling
        least, most = -((-low * safe) // 100), (high * safe) // 100
        least = np.where(there & (least <= most), least, np.iinfo(np.int64).max)

        def floor(rows):
            open_ = np.stack([np.maximum(least[rows, j], lists[j].score[rows, -1]) for j in range(len(lists))], axis=1)
            return open_.min(axis=1).astype(float)

        def meet(rows, part, score):
            other = anchors["label"][rows][:, None] != items["label"][part]
            for j, found in enumerate(lists):
                fits = other & (score >= least[rows, j:j + 1]) & (score <= most[rows, j:j + 1])
                found.add(rows, score, items["id"][part], fits)

        if lists:
            walk(anchors["q"], items["q"], centres, anchors["cluster"], floor, meet)
        out = [(row, np.full(len(row), j), found.id[row, col], found.score[row, col])
               for j, found in enumerate(lists) for row, col in [np.nonzero(found.score != _NONE)]]
        row, slot, other, score = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (
            zip(*out, strict=True) if out else [[]] * 4))
        return {"aid": anchors["aid"][row.astype(int)], "slot": slot.astype(np.int32), "other": other, "score": score}

    return run


def _grid(anchors: DataFrame, items: DataFrame, groups: int, segments: int, centres: np.ndarray, d: int, cell,
          schema: str, width: int) -> DataFrame:
    """``cell`` on every (group of anchors, segment of candidates): anchors go to
    each segment, candidates to each group."""
    arrow = arrow_schema(anchors.sparkSession, schema)
    a = anchors.select("grp", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("seg"),
                       F.lit(True).alias("anchor"), "aid", "id", "label", "q", "cluster", "bands")
    x = items.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "seg", F.lit(False).alias("anchor"),
                     F.lit(None).cast("long").alias("aid"), "id", "label", "q", F.lit(None).cast("int").alias("cluster"),
                     F.lit(None).cast("array<bigint>").alias("bands"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_anchor = table["anchor"].to_numpy()
        sides = []
        for side in (is_anchor, ~is_anchor):
            part = table.filter(pa.array(side)).combine_chunks()
            one = {c: part[c].to_numpy() for c in ("id", "label")}
            q = part["q"].chunk(0) if part.num_rows else pa.array([], pa.list_(pa.int64()))
            sides.append(one | {"q": matrix(q, d), "table": part})
        own, others = sides
        if not len(own["id"]) or not len(others["id"]):
            return arrow.empty_table()
        part = own["table"]
        own |= {"aid": part["aid"].to_numpy(), "cluster": part["cluster"].to_numpy().astype(int)}
        bands = np.full((part.num_rows, width), _NONE)
        for row, scores in enumerate(part["bands"].to_pylist()):
            bands[row, :len(scores)] = scores
        own["bands"] = bands
        out = cell(own, others, centres)
        return pa.table([pa.array(out[n], arrow.field(n).type) for n in arrow.names], schema=arrow)

    return a.unionByName(x).groupBy("grp", "seg").applyInArrow(run, schema)


def mine_hard_negatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                        every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                        high: int = HIGH, clusters: int = CLUSTERS, anchors_per_group: int = ANCHORS,
                        candidates_per_segment: int = CANDIDATES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    Anchors are the rows whose id ``every`` divides; a negative's score lies
    between ``low`` and ``high`` hundredths of the positive's."""
    spark = vectors.sparkSession
    rows = written(quantised(vectors, key, vector, label), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("d"),
                    F.count_if(F.col("id") % every == 0).alias("anchors")).first()
    d, chosen = size.d, rows.where(F.col("id") % every == 0)
    sample = (smallest_hashes(chosen, "id", FIT_ROWS, size.anchors).select("q", F.xxhash64("id").alias("h"))
              .orderBy("h").limit(FIT_ROWS).select("q").toArrow())
    fit = matrix(sample["q"].combine_chunks(), d) if sample.num_rows else np.zeros((0, d), np.int64)
    centres = fit_centroids(directions(fit)[0], max(1, min(clusters, int(np.sqrt(size.anchors)))))

    with_cluster = "id long, label long, q array<bigint>, cluster int"
    arrow = arrow_schema(spark, with_cluster)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, _ = directions(matrix(batch.column(2), d))
            near = np.argmax(unit @ centres.T, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], schema=arrow)

    placed = written(rows.mapInArrow(assign, with_cluster), "vectors-clusters")

    def dealt(table: DataFrame, per: int, out: str) -> tuple[DataFrame, int]:
        """Rows along the clusters, in runs of about ``per``; at most ``clusters`` counts reach the driver."""
        counts = {r.cluster: r.n for r in table.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
        start, at = {}, 0
        for c in sorted(counts):
            start[c], at = at, at + counts[c]
        if not counts:
            return table.withColumn(out, F.lit(0)), 1
        first = F.create_map(*[F.lit(v) for c in counts for v in (c, start[c])])[F.col("cluster")]
        many = F.create_map(*[F.lit(v) for c in counts for v in (c, counts[c])])[F.col("cluster")]
        # repeated ids are spread as well: the hash takes the row's vector and label
        place = first + F.pmod(F.xxhash64("id", "label", "q"), many)
        return table.withColumn(out, F.floor(place / per).cast("int")), -(-at // per)

    anchors = placed.where(F.col("id") % every == 0).distinct()
    anchors, groups = dealt(written(anchors.withColumn("aid", F.xxhash64("id", "label", "q")), "anchors"), anchors_per_group, "grp")
    items, segments = dealt(placed, candidates_per_segment, "seg")

    empty = F.array().cast("array<bigint>")
    found = _grid(anchors.withColumn("bands", empty), items, groups, segments, centres, d, _cell_positives(positives),
                  "aid long, other long, score long", 0)
    nth = F.row_number().over(Window.partitionBy("aid").orderBy(F.desc("score"), "other"))
    first = written(found.withColumn("nth", nth).where(F.col("nth") <= positives), "positives")
    bands = first.groupBy("aid").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "score"))), lambda s: s["score"]).alias("bands"))
    found = _grid(anchors.join(bands, "aid"), items, groups, segments, centres, d, _cell_negatives(negatives, low, high),
                  "aid long, slot int, other long, score long", positives)
    nth = F.row_number().over(Window.partitionBy("aid", "slot").orderBy(F.desc("score"), "other"))
    ranked = found.withColumn("rank", nth).where(F.col("rank") <= negatives)
    ranked = ranked.select("aid", (F.col("slot") + 1).alias("nth"), "rank", F.col("other").alias("negative_id"),
                           F.col("score").alias("negative_score"))
    pairs = first.select("aid", "nth", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("aid", F.col("id").alias("anchor_id"))
    return ranked.join(pairs, ["aid", "nth"]).join(named, "aid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
