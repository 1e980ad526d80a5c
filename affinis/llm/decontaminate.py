"""Operator 10: benchmark decontamination, in DataFrame functions only.

Texts are taken as words.  A benchmark item's windows are its runs of ``WINDOW``
consecutive words; an item with fewer (but some) words is one window.  A
training text is searched for all of them, whole, and every word inside an
occurrence is hit.

The hash set: the benchmark's windows are put into an array of buckets by their
hash, and that array, a literal of the plan, goes to the executors once with
the job.  Each text window's hash picks one bucket; the windows found there are
verified word by word.  All this happens inside a document's row, without a
join or a shuffle.  The set is built so only while the benchmark has at most
``max_windows`` windows (``MAX_WINDOWS``, about 30 MB); beyond, the text windows
are exploded and joined with the benchmark's by shuffle, with equal results.

* Null and empty texts have no words: n_words 0, no hit.  Items without words have no window.
* Equal rows of documents are each given their result; equal windows of several items name all of them.
* An empty benchmark finds nothing; an empty table gives no rows.
* Results are added to the document's columns; ones of the same names are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import item_words, let, written

WINDOW = 13
MAX_WINDOWS = 200_000
_ENTRY = "struct<h:bigint,t:array<string>,i:array<string>>"
_HITS = "array<struct<at:int,len:int,items:array<string>>>"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """(words, items): distinct windows and the items that hold them."""
    items = benchmark.select(F.col(key).cast("string").alias("item"), item_words(F.col(text)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    runs = items.where(F.size("w") > 0).select("item", F.explode(F.transform(
        starts, lambda i: F.slice("w", i, F.least(F.lit(window), F.size("w"))))).alias("words"))
    return runs.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _window_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.slice(words, at, length))


def _starts(words: Column, length: int) -> Column:
    n = F.size(words)
    return F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))


def _table(rows: list, buckets: int) -> Column:
    """The windows as an array of buckets: one literal of the plan."""
    cells: list[list] = [[] for _ in range(buckets)]
    for r in rows:
        cells[r.h % buckets].append({"h": r.h, "t": list(r.words), "i": list(r["items"])})
    return F.from_json(F.lit(json.dumps(cells)), f"array<array<{_ENTRY}>>")


def _hits_of_length(words: Column, rows: list, length: int) -> Column:
    buckets = 1 << max(4, (2 * len(rows)).bit_length())
    table = _table(rows, buckets)

    def entries(i: Column) -> Column:
        h = _window_hash(words, i, length)
        cell = F.get(table, F.pmod(h, F.lit(buckets)).cast("int"))
        return F.filter(cell, lambda e: (e["h"] == h) & (e["t"] == F.slice(words, i, length)))

    def hit(i: Column) -> Column:
        return F.struct((i - 1).cast("int").alias("at"), F.lit(length).alias("len"),
                        F.flatten(F.transform(entries(i), lambda e: e["i"])).alias("items"))

    return F.transform(F.filter(_starts(words, length), lambda i: F.size(entries(i)) > 0), hit)


def _hits_in_row(words: Column, rows: list) -> Column:
    """Verified hits (first word from 0, length, items), by start."""
    found = [_hits_of_length(words, [r for r in rows if len(r.words) == n], n)
             for n in sorted({len(r.words) for r in rows})]
    return F.array_sort(F.concat(*found)).cast(_HITS) if found else F.array().cast(_HITS)


def _result(n_words: Column, hits: Column, word_share: int) -> Column:
    """What is reported of a document, as one struct."""

    def of_spans(spans: Column) -> Column:
        return let(F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]), lambda n_hit: F.struct(
            n_words.cast("long").alias("n_words"), n_hit.alias("n_hit"), spans.alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(hits["items"]))).alias("items"),
            ((n_hit > 0) & (word_share * n_hit >= n_words)).alias("contaminated")))

    return let(_spans(hits), of_spans)


def _hits_by_join(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """The same hits by exploding and joining; adds ``_hits`` to docs."""
    lengths = [r.n for r in windows.select(F.size("words").alias("n")).distinct().collect()]  # at most WINDOW values
    texts = docs.select(F.xxhash64(text).alias("_k"), F.col(text).cast("string").alias("_t")).distinct()
    texts = texts.withColumn("w", item_words(F.col("_t")))

    def runs_of(words: Column, n: int) -> Column:
        return F.transform(_starts(words, n), lambda i: F.struct(
            (i - 1).cast("int").alias("at"), F.lit(n).alias("len"), F.slice(words, i, n).alias("words")))

    def all_runs(words: Column) -> Column:
        return F.concat(*(runs_of(words, n) for n in sorted(lengths)))

    each = texts.select("_k", F.md5("_t").alias("_m"), F.explode(let(F.col("w"), all_runs)).alias("r"))
    each = each.select("_k", "_m", "r.at", "r.len", "r.words")
    joined = each.join(windows, "words").groupBy("_k", "_m").agg(
        F.array_sort(F.collect_list(F.struct("at", "len", "items"))).cast(_HITS).alias("_hits"))
    keyed = docs.withColumn("_k", F.xxhash64(text)).withColumn("_m", F.md5(F.coalesce(F.col(text), F.lit(""))))
    out = keyed.join(joined, ["_k", "_m"], "left")
    return out.withColumn("_hits", F.coalesce("_hits", F.array().cast(_HITS))).drop("_k", "_m")


def _spans(hits: Column) -> Column:
    """Hits sorted by start as disjoint spans (first word, end word)."""
    none = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc: Column, h: Column) -> Column:
        last = F.element_at(acc, -1)
        a, b = h["at"], h["at"] + h["len"]
        apart = (F.size(acc) == 0) | (a > last["b"])
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1),
                         F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], b).alias("b"))))
        return F.when(apart, F.concat(acc, F.array(F.struct(a.alias("a"), b.alias("b"))))).otherwise(grown)

    return F.aggregate(hits, none, step)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
         max_windows: int = MAX_WINDOWS, word_share: int = 20) -> DataFrame:
    """``docs`` with n_words, n_hit, spans (first and end word), items (sorted
    ids with a window there) and contaminated (n_hit > 0 and ``word_share`` *
    n_hit >= n_words)."""
    made = ["n_words", "n_hit", "spans", "items", "contaminated"]
    kept = [c for c in docs.columns if c not in made]
    windows = written(benchmark_windows(benchmark, window), "benchmark-windows")
    rows = windows.select("words", "items", F.xxhash64("words").alias("h")).limit(max_windows + 1).collect()
    base = docs.select(*kept)
    if len(rows) <= max_windows:
        found = let(item_words(F.col(text)), lambda w: let(
            _hits_in_row(w, rows), lambda hits: _result(F.size(w), hits, word_share)))
        out = base.withColumn("_r", found)
    else:
        out = _hits_by_join(base, windows, text).withColumn(
            "_r", _result(F.size(item_words(F.col(text))), F.col("_hits"), word_share))
    return out.select(*kept, *(F.col("_r")[c].alias(c) for c in made))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Documents that are not contaminated, with their own columns."""
    return scan(docs, benchmark, **how).where("not contaminated").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """All documents; the text of one with hits becomes its words outside the
    hit spans, joined by spaces."""
    found = scan(docs, benchmark, text=text, **how)
    words = item_words(F.col(text))
    outside = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: ~F.exists(
        "spans", lambda s: (i > s["a"]) & (i <= s["b"])))
    left = F.array_join(F.transform(outside, lambda i: F.get("_w", i - 1)), " ")
    cleaned = F.when(F.size("spans") == 0, F.col(text)).otherwise(left)
    return found.withColumn("_w", words).withColumn(text, cleaned).select(*docs.columns)
