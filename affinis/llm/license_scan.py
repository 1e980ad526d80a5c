"""Operator 3: fuzzy search for short licence notices.

A notice may stand with up to ``k`` character edits.  Cut into k + 1 parts, at
least one part must then stand exactly (pigeonhole), so exact searches for the
parts give all candidate places; there the ``regex`` library matches the whole
notice with at most ``k`` errors and reports the span.  Both work on the text's
words joined by single spaces, so layout and punctuation do not count as edits.

Exact places of the base phrases are counted apart (``n_base`` and the first
and last word where one starts).  Fuzzy findings add labels; base labels stay.

Null and empty texts have no words and no label; equal rows get equal results;
an empty table gives no rows; whole texts are searched, however long.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import ITEM_BYTES, map_rows, utf8

#: The phrases that count exactly, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices searched with errors, with their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2", "apache-2"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("all rights reserved", "all-rights-reserved"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


def word_numbers(line: bytes) -> Callable[[int], int]:
    """The word that the space at a place stands before; the spaces are counted
    once, when first asked for."""
    spaces: list[np.ndarray] = []

    def number(at: int) -> int:
        if not spaces:
            spaces.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32))
        return int(np.searchsorted(spaces[0], at, "right")) - 1

    return number


@dataclass(frozen=True)
class Span:
    label: str
    first_word: int
    last_word: int
    errors: int
    similarity: float


def edits_allowed(notice: str, chars_per_edit: int = 10, most: int = 4) -> int:
    """One edit for every ten characters, four at most."""
    return min(most, len(notice) // chars_per_edit)


def seeds(notice: str, k: int) -> list[tuple[int, bytes]]:
    """The notice cut into k + 1 nearly equal parts, with their offsets."""
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices=NOTICES, base=BASE):
        self.base = [(f" {p} ".encode(), label) for p, label in base]
        self.notices = []
        for notice, label in notices:
            k = edits_allowed(notice)
            pattern = regex.compile(rf"(?<!\S)(?:{re.escape(notice)}){{e<={k}}}(?!\S)", regex.BESTMATCH)
            self.notices.append((notice, label, k, seeds(notice, k), pattern))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[Span]]:
        """(words, exact base places as (word, label), fuzzy spans)."""
        words = utf8(text).translate(ITEM_BYTES).split()
        line = b" " + b" ".join(words) + b" "
        word_at = word_numbers(line)
        exact = []
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                exact.append((word_at(at), label))
                at = line.find(phrase, at + 1)
        return len(words), exact, self._fuzzy(line, word_at)

    def _fuzzy(self, line: bytes, word_at: Callable[[int], int]) -> list[Span]:
        found = []
        for notice, label, k, parts, pattern in self.notices:
            places = set()
            for offset, part in parts:
                at = line.find(part)
                while at >= 0:
                    places.add(at - offset)
                    at = line.find(part, at + 1)
            for a, b in _windows(sorted(places), len(notice) + k, 4 * k + 4):
                # characters beyond ASCII take up to four bytes: k of them may stand in;
                # no notice starts or ends inside a word, so the window need not either
                a, b = line.find(b" ", max(0, a)), line.rfind(b" ", 0, max(0, b)) + 1
                if a < 0:
                    continue
                part = line[a:b].decode("utf-8", "ignore")
                ascii_only = len(part) == b - a
                for m in _matches(pattern, part, len(notice) - k):
                    first = word_at(a + (m.start() if ascii_only else len(part[:m.start()].encode())))
                    last = first + m.group().strip().count(" ")
                    errors = sum(m.fuzzy_counts)
                    found.append(Span(label, first, last, errors, 1.0 - errors / len(notice)))
        return _closest(found)


def _closest(found: list[Span]) -> list[Span]:
    """Of spans that share words the one with the highest similarity (then the
    first): notices that differ in little more than k characters match each
    other's places."""
    taken: list[Span] = []
    held: set[int] = set()
    for s in sorted(found, key=lambda s: (-s.similarity, s.first_word, s.label)):
        own = range(s.first_word, s.last_word + 1)
        if held.isdisjoint(own):
            taken.append(s)
            held.update(own)
    return sorted(taken, key=lambda s: s.first_word)


def _matches(pattern: regex.Pattern, part: str, least: int) -> list[regex.Match]:
    """Matches of a window: the best one, then those of the stretches before and
    after it (the library's own search goes on after the best one only)."""
    out, stretches = [], [(0, len(part))]
    while stretches:
        a, b = stretches.pop()
        if b - a >= least and (m := pattern.search(part, a, b)):
            out.append(m)
            stretches += [(a, m.start()), (m.end(), b)]
    return out


def _windows(places: list[int], length: int, margin: int) -> list[tuple[int, int]]:
    """Ranges that hold every candidate match, those of near places in one.  A
    range is at most twice as long as a match, so ranges may overlap."""
    out: list[tuple[int, int]] = []
    first = None
    for p in places:
        if first is not None and p - first <= length:
            out[-1] = (out[-1][0], p + length + margin)
        else:
            first = p
            out.append((p - margin, p + length + margin))
    return out


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", notices=NOTICES, base=BASE) -> DataFrame:
    """One row per document: n_words, base_places (word, label), spans (label,
    first_word, last_word, errors, similarity)."""
    schema = ("k long, n_words long, base_places array<struct<word:bigint,label:string>>, "
              "spans array<struct<label:string,first_word:bigint,last_word:bigint,errors:int,similarity:double>>")
    made: list[Scanner] = []

    def rows(batch: dict) -> dict:
        if not made:
            made.append(Scanner(notices, base))
        found = [made[0].scan(t) for t in batch["t"]]
        return {"k": batch["k"], "n_words": [f[0] for f in found],
                "base_places": [[{"word": w, "label": x} for w, x in f[1]] for f in found],
                "spans": [[vars(s) for s in f[2]] for f in found]}

    names = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return map_rows(names, rows, schema).withColumnRenamed("k", key)


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and joined labels of scanned documents."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, both = F.col("base_places.label"), F.concat(F.col("base_places.label"), F.col("spans.label"))
    return scanned.select(
        key, "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places.word").alias("first_word"), F.array_max("base_places.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(both).alias("labels"),
        F.when(F.size("base_places") > 0, F.lit(1.0)).otherwise(
            F.coalesce(F.array_max("spans.similarity"), F.lit(0.0))).alias("score"),
        F.size("spans").cast("long").alias("n_spans"))
