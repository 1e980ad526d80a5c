"""Operator 8: toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts (P) and unlabelled ones (U), no negatives.
With class prior pi the risk of a classifier g under loss l is

    pi * E_P[l(g, +)]  +  max(0, E_U[l(g, -)] - pi * E_P[l(g, -)])

The second term estimates the risk on negatives; where it falls below zero the
step goes against it instead, which keeps the fit from overtaking the
unlabelled toxic texts.  The loss is the logistic loss; g is linear in words and
beginnings of words that a text holds.

P and U are samples bounded by ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` (smallest
hash of the id; ids alone are sorted, their texts then found by a broadcast of
these bounded ids).  The words are those that are significantly commoner in P
than in U, at most ``MAX_WORDS``.  Everything else covers all rows.

* pi is ``prior``, or estimated: words that only toxic texts hold are pi times as common in U as in P, so pi is the
  ratio of these rates over the clearest words (labels may be a biased sample, so their share of toxic is no prior).
* Rows train only if ``may_train`` allows their id; several labels of one id count as the largest; null labels are none.
* Without positive labels every score is the share of toxic among the labels (0 without any).
* Null and empty texts hold no word; equal texts get equal scores; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import ITEM_BYTES, map_rows, smallest_hashes, utf8

#: Bounds of the training samples (documents) and of the vocabulary.
MAX_POSITIVE, MAX_UNLABELLED, MAX_WORDS = 8_000, 24_000, 4_000
#: Words that the class prior is read from.
PRIOR_WORDS = 30


def word_set(text: str | None) -> set[bytes]:
    """A text's distinct words, and the beginnings of the longer ones."""
    words = set(utf8(text).translate(ITEM_BYTES).split())
    return words | {b"^" + w[:4] for w in words if len(w) > 4}


@dataclass
class Model:
    words: dict[bytes, float]
    bias: float

    def score(self, text: str | None) -> float:
        margin = self.bias + sum(map(self.words.__getitem__, word_set(text) & self.words.keys()))
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -40.0, 40.0))))


def fit(positive: list[list[int]], unlabelled: list[list[int]], n_words: int, prior: float, steps: int = 1000,
        rate: float = 0.1, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk.  Rows are
    lists of word numbers; at least one row in each list."""

    def rows(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
        sizes = [len(d) for d in docs]
        return np.repeat(np.arange(len(docs)), sizes), np.array([w for d in docs for w in d], np.int64), len(docs)

    p_row, p_word, n_p = rows(positive)
    u_row, u_word, n_u = rows(unlabelled)
    theta = np.zeros(n_words + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def margins(row, word, n):
        return theta[-1] + np.bincount(row, theta[word], n)

    def pull(row, word, n, slope):
        return np.r_[np.bincount(word, slope[row], n_words), slope.sum()] / n

    for step in range(1, steps + 1):
        g_p, g_u = margins(p_row, p_word, n_p), margins(u_row, u_word, n_u)
        negative_risk = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        s_p, s_u = (1 / (1 + np.exp(-np.clip(g, -40, 40))) for g in (g_p, g_u))
        negative = pull(u_row, u_word, n_u, s_u) - prior * pull(p_row, p_word, n_p, s_p)
        if negative_risk >= 0:
            slope = negative - prior * pull(p_row, p_word, n_p, 1 - s_p)
        else:
            slope = -negative
        slope[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _vocabulary(sample: DataFrame, n_p: int, n_u: int, max_words: int) -> list[tuple[bytes, float, float]]:
    """Words over three times as common in P as in U, and by more than chance,
    clearest first, with their rates in both.  Counts of words are combined
    before they are shuffled."""
    words = sample.select("positive", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.sum(F.col("positive").cast("int")).alias("p"),
                                       F.sum((~F.col("positive")).cast("int")).alias("u"))
    p, u = F.col("p") / n_p, F.col("u") / n_u
    spread = F.sqrt(p / n_p + (u + 1.0 / n_u) / n_u)
    picked = (counts.where((F.col("p") >= 3) & (p > 3 * u) & (p - u > 2.5 * spread))
              .orderBy(F.desc((p - u) / spread), "word").limit(max_words))
    return [(bytes(r.word), r.p / n_p, r.u / n_u) for r in picked.select("word", "p", "u").collect()]


def train(docs: DataFrame, labels: DataFrame, may_train: Column, prior: float | None = None, key: str = "doc_id",
          text: str = "text", label: str = "toxic", max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED, max_words: int = MAX_WORDS) -> Model:
    spark = docs.sparkSession
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    marks = (labels.where(may_train & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y")))
    seen = marks.agg(F.avg("y").alias("p"), F.sum(F.when(F.col("y") == 1, 1)).alias("n")).first()
    share = seen.p
    share = min(max(float(share or 0.0), 0.0), 1.0)
    ids = docs.select(F.col(key).cast("long").alias("doc_id")).where(may_train).where("doc_id is not null")
    n_ids = ids.count()
    p_ids = [r.doc_id for r in smallest_hashes(marks.where("y = 1"), "doc_id", max_positive, seen.n or 0).orderBy(*order).limit(max_positive).collect()]
    u_ids = [r.doc_id for r in smallest_hashes(ids, "doc_id", max_unlabelled, n_ids).distinct().orderBy(*order).limit(max_unlabelled).collect()]
    never = Model({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if not p_ids or not u_ids:
        return never
    # one text may be in both samples: U is drawn from all texts
    picked = spark.createDataFrame([(i, True) for i in p_ids] + [(i, False) for i in u_ids], "doc_id long, positive boolean")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    sample = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "positive", "t")
    held = map_rows(sample, lambda b: {"positive": b["positive"], "words": [sorted(word_set(t)) for t in b["t"]]},
                    "positive boolean, words array<binary>")
    vocabulary = _vocabulary(held, len(p_ids), len(u_ids), max_words)
    if not vocabulary:
        return never
    number = {w: i for i, (w, _, _) in enumerate(vocabulary)}
    clear = vocabulary[:PRIOR_WORDS]
    pi = prior if prior is not None else min(0.95, sum(u for _, _, u in clear) / sum(p for _, p, _ in clear))
    rows = map_rows(sample, lambda b: {"doc_id": b["doc_id"], "positive": b["positive"], "at": [
        sorted(number[w] for w in word_set(t) & number.keys()) for t in b["t"]]},
        "doc_id long, positive boolean, at array<int>")
    found = sorted((r.positive, r.doc_id, r["at"]) for r in rows.collect())  # bounded: word numbers of the two samples
    p_rows, u_rows = [f[2] for f in found if f[0]], [f[2] for f in found if not f[0]]
    if not p_rows or not u_rows:
        return never
    weights, bias = fit(p_rows, u_rows, len(vocabulary), pi)
    return Model(dict(zip(number, weights.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    picked = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return map_rows(picked, lambda b: {"doc_id": b["k"], "score": [model.score(t) for t in b["t"]]},
                    "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, may_train: Column, **bounds) -> DataFrame:
    return score(docs, train(docs, labels, may_train, **bounds))


__all__ = ["Model", "fit", "score", "score_documents", "train", "word_set"]
