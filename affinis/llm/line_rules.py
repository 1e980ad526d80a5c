"""Operator 5: quality rules, among them the line frequency across documents.

Lines are normalised (A-Z lower-cased, digits as 0, white space runs as one
space) and hashed.  For every host, the documents that hold a line are counted;
a line is boilerplate of its host if at least ``min_docs`` documents hold it,
and they are ``many_docs`` or ``min_share`` of the host's documents, so a large
host hides no line that would be boilerplate on a small one.  Such lines are
removed, and a document is rejected as depleted when under ``min_left`` of its
words remain.

Copies must not pass for a template: documents with the same set of lines count
as one document.  Documents that share most lines, but not all, count each:
pages of a template with little of their own are what the depleted rule is for,
and by their lines near copies cannot be told from them.

A text's own figures (words, symbols, repeated lines, repeated three-word
windows) come from one pass over whole texts in Arrow batches.  Line rows are
counted with map-side combining under (host, line), so neither a common line
nor a large host gathers in one task.

Null text: no words.  Null host: a host of its own.  Equal rows get equal
results each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import LOWER_BYTES, map_rows, unused, utf8, written

_LINE_BYTES = bytes(0x30 if 0x31 <= b <= 0x39 else LOWER_BYTES[b] for b in range(256))
SYMBOLS = "#*$%&|<>"  # fixed values
SPACES = " \t\n\x0b\x0c\r"  # fixed values

#: A boilerplate line is in so many documents and such a share of its host's;
#: documents keep at least this share of their words.
MIN_DOCS, MIN_SHARE, MIN_LEFT = 5, 0.05, 0.3
#: In so many documents a line needs no share of its host's: as many as make it
#: boilerplate on a small host, so the share decides only where this is raised.
MANY_DOCS = MIN_DOCS
#: Boilerplate lines that may be broadcast (24 bytes each).
BROADCAST_LINES = 200_000


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    pair = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
    three = pair[:-1].astype(np.int64) * len(names) + ids[2:]
    _, which, counts = np.unique(three, return_inverse=True, return_counts=True)
    hit = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= hit
    return int(covered.sum())


def line_hash(words: list[bytes]) -> int:
    """Signed order-keeping form of the first eight bytes of the line's md5."""
    return int.from_bytes(hashlib.md5(b" ".join(words)).digest()[:8]) - (1 << 63)


def text_figures(text: str | None) -> dict:
    text = text or ""
    words = utf8(text).split()
    lines: Counter[int] = Counter()
    held = []
    for line in text.split("\n"):
        own = utf8(line).translate(_LINE_BYTES).split()
        if own:
            held.append(line)
            lines[line_hash(own)] += len(own)
    return {"n_words": len(words), "word_chars": len(text) - sum(map(text.count, SPACES)),
            "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": len(held) - len(set(held)),
            "n_repeat_words": repeated_words(words), "lines": list(lines), "line_words": list(lines.values())}


_FIGURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "lines array<bigint>, line_words array<int>")


def figures(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: key, host, the text's own figures, distinct line hashes and their words."""
    names = _FIGURES.split(", ")

    def rows(batch: dict) -> dict:
        found = [text_figures(t) for t in batch["t"]]
        return {"k": batch["k"], "host": batch["host"], "text_hash": batch["text_hash"]} | {
            c: [f[c] for f in found] for c in (n.split()[0] for n in names)}

    picked = docs.select(F.col(key).cast("long").alias("k"), F.col(host).cast("string").alias("host"),
                         F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
                         F.col(text).cast("string").alias("t"))
    return map_rows(picked, rows, "k long, host string, text_hash long, " + _FIGURES)


def _host() -> Column:
    """The host as a key; null is a host of its own, not the empty one."""
    return F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("host")


def _signature() -> Column:
    """What exact copies share: the whole set of line hashes."""
    return F.array_sort("lines")


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE,
                   many_docs: int = MANY_DOCS) -> DataFrame:
    """(host, line, n_docs) of boilerplate lines.  A host has at most (lines of
    its documents) / min_docs of them."""
    per_doc = rows.where(F.size("lines") > 0).select(
        _host(), "lines", F.xxhash64(_signature()).alias("sig"))
    docs = per_doc.groupBy("host", "sig").count().groupBy("host").agg(F.count("*").alias("host_docs"))
    seen = per_doc.select("host", "sig", F.explode("lines").alias("line")).distinct()
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    return (counts.join(docs, "host")
            .where((F.col("n_docs") >= many_docs) | (F.col("n_docs") >= F.col("host_docs") * min_share))
            .select("host", "line", "n_docs"))


def apply_rules(rows: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE,
                min_left: float = MIN_LEFT, broadcast_lines: int = BROADCAST_LINES,
                many_docs: int = MANY_DOCS) -> DataFrame:
    """Adds to materialised ``figures``: rid, n_removed_words, removed (line
    hashes), base_failed, kept."""
    rows = rows.withColumn("rid", F.monotonically_increasing_id())  # of a written table: stable
    frequent = written(frequent_lines(rows, min_docs, min_share, many_docs).select("host", "line"), "frequent-lines")
    few = frequent.count() <= broadcast_lines
    pairs = rows.select("rid", _host(), F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    pairs = pairs.select("rid", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("n"))
    hits = pairs.join(F.broadcast(frequent) if few else frequent, ["host", "line"])
    removed = hits.groupBy("rid").agg(F.sum("n").alias("n_removed_words"), F.collect_set("line").alias("removed"))
    out = rows.drop("lines", "line_words").join(removed, "rid", "left")
    gone = F.coalesce("n_removed_words", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumns({
        "n_removed_words": gone.cast("long"),
        "removed": F.coalesce("removed", F.array().cast("array<bigint>")),
        "base_failed": failed,
        "kept": ~failed & (F.col("n_words") - gone >= F.col("n_words") * min_left)})


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The verdict for every row of ``docs``."""
    return apply_rules(written(figures(docs, key, text, host), "line-figures"), **limits)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
          count: str = "n_chars", **limits) -> DataFrame:
    """Documents that pass, with their boilerplate lines removed; columns as
    they came (``count``, if there, follows the text's new length)."""
    k, h, t, bad = unused(docs, "_k", "_h", "_t", "_removed")
    verdict = (judge(docs, key, text, host, **limits).where("kept")
               .select(F.col("k").alias(k), F.col("host").alias(h), F.col("text_hash").alias(t),
                       F.col("removed").alias(bad)).dropDuplicates([k, h, t]))
    body = F.col(text).cast("string")
    kept = docs.join(verdict, F.col(key).cast("long").eqNullSafe(F.col(k))
                     & F.col(host).cast("string").eqNullSafe(F.col(h)) & (F.xxhash64(body) == F.col(t)))
    names, columns = list(docs.columns), docs.dtypes
    schema = ", ".join(f"`{n}` {t}" for n, t in columns)
    changed = kept.where(F.size(bad) > 0)

    def drop_lines(batches):
        import pyarrow as pa

        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(names)}
            texts = []
            for t, lost in zip(cols[text].to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                gone = set(lost)
                texts.append("\n".join(x for x in t.split("\n") if not (
                    (own := utf8(x).translate(_LINE_BYTES).split()) and line_hash(own) in gone)))
            cols[text] = pa.array(texts, cols[text].type)
            if count in cols:
                cols[count] = pa.array([len(t) for t in texts], cols[count].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    parted = kept.where(F.size(bad) == 0).select(*names)
    return parted.unionByName(changed.select(*names, bad).mapInArrow(drop_lines, schema))
