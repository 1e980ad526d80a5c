"""Operator 11: spelling variants grouped through pivotal grams.

Words are counted over whole texts and every pair of words that differ by one
inserted, deleted or replaced code point is found:

* Bigrams are ordered by how many words hold them, rarest first.  A word's
  *prefix* is its first three bigrams in that order and any that equal the
  third.  Its two *pivots* are disjoint bigrams of the prefix with the least
  total of word counts, chosen by dynamic programming over their places.
* One edit leaves one of a word's two disjoint pivots whole.  Of two near
  words, take the one whose prefix ends first in the order: its whole pivot is
  a bigram of the other word too, and stands in the other's prefix.  So pivots
  are looked up among the prefixes of all other words.
* Position limits: the edit lies left or right of the surviving pivot.  If
  right, both words agree up to the pivot, which stands at one place in both;
  if left, they agree from the pivot on, at one distance from the end.  Where
  that leaves under ``PLAIN`` agreeing code points, the other side of the pivot
  is halved: the edit spares one half, which agrees too.  The lookup is an
  equi-join on place and agreeing code points, with short lists, and
  ``levenshtein`` verifies inside it.
* A pair is found once: by the pivots of the word whose prefix ends first, by
  the second pivot only where the first does not stand, on the right only where
  the left does not agree.  No pairs need to be made distinct.

A word's *form* is its near word of largest count if that is ``ratio`` times
its own; roots follow forms (each step multiplies the count by the ratio, so
chains are short) by pointer jumping.

Null text: no words.  A null id counts as an empty one.  Repeated rows count
each.  A run of any length is one word.  Ties of count: the smallest word in
code-point order.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import LOWER_BYTES, arrow_schema, utf8, written

MIN_LENGTH, MIN_COUNT, RATIO, DAMAGE = 7, 2, 10, 31  # fixed values of the contract
#: Agreeing code points, pivot included, that make a key by themselves; code
#: points of one stretch that a key takes at most.
PLAIN, CONTEXT = 5, 16
#: Distinct words a task holds before it hands its counts on.
HELD_WORDS = 200_000
#: Steps of pointer jumping: 2^6 forms in a row, each of ten times the count.
JUMPS = 6


def damaged(run: str, crc: int) -> str:
    """``run`` without one code point if its hash says so; ``crc`` is that of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), crc)
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): distinct words and their occurrences in all of ``docs``."""
    arrow = arrow_schema(docs.sparkSession, "word string, n long")
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for key_, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                crc = zlib.crc32(f"{'' if key_ is None else key_}:".encode())
                low = utf8(body.as_py()).translate(LOWER_BYTES).decode("utf-8", "surrogatepass")
                for run, n in Counter(runs.findall(low)).items():
                    word = damaged(run, crc)
                    if len(word) >= min_length:
                        total[word] += n
                if len(total) >= HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()))], schema=arrow)
                    total = Counter()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()))], schema=arrow)

    picked = docs.select(F.col(key).cast("string"), F.col(text).cast("string"))
    return (picked.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def pivots(places: list[int], cost: list[int]) -> tuple[int, int]:
    """The two disjoint bigrams of least total cost among bigrams at ascending
    ``places``: by dynamic programming, the cheapest one that ends before each."""
    best, pair, done, cheapest = None, None, 0, None
    for j, place in enumerate(places):
        while done < j and places[done] <= place - 2:
            if cheapest is None or cost[done] < cost[cheapest]:
                cheapest = done
            done += 1
        if cheapest is not None and (best is None or cost[cheapest] + cost[j] < best):
            best, pair = cost[cheapest] + cost[j], (places[cheapest], place)
    if pair is None:
        raise ValueError("three bigrams always hold two disjoint ones")
    return pair


def signature(word: str, held_by: dict[str, int]) -> tuple[list[int], tuple[int, int], int]:
    """Places of a word's prefix, its two pivots, and where the prefix ends in the order."""
    grams = [word[i:i + 2] for i in range(len(word) - 1)]
    last = sorted(held_by[g] for g in grams)[2]
    places = [i for i, g in enumerate(grams) if held_by[g] <= last]
    return places, pivots(places, [held_by[grams[i]] for i in places]), last


def keys_at(word: str, p: int, lengths: Iterable[int]) -> Iterator[tuple[str, int, str]]:
    """(kind, parted, key) under which a bigram at place ``p`` is looked up by
    words of the ``lengths``.  Kinds: agreement left (L) or right (R) of it, with
    the first (A) or last (B) half of the other side; ``parted`` is the number
    of code points that A takes from the start."""
    size = len(word)
    if p + 2 >= PLAIN:
        yield "L", 0, f"L{p} {word[max(0, p - CONTEXT):p + 2]}"
    else:
        for own in lengths:
            a = (own - p - 2) // 2
            b = own - p - 2 - a
            yield "LA", p + 2 + a, f"LA{own} {p} {word[:p + 2 + min(a, CONTEXT)]}"
            yield "LB", p + 2 + a, f"LB{own} {p} {word[:p + 2]} {word[size - min(b, CONTEXT):] if b else ''}"
    rest = size - p
    if rest >= PLAIN:
        yield "R", 0, f"R{rest} {word[p:p + 2 + CONTEXT]}"
    else:
        for own in lengths:
            a = (own - rest) // 2
            b = own - rest - a
            yield "RA", a, f"RA{own} {rest} {word[:min(a, CONTEXT)]} {word[p:]}"
            yield "RB", a, f"RB{own} {rest} {word[max(0, p - min(b, CONTEXT)):]}"


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Bigrams numbered by how many words hold them, ties in code-point order.
    Letters of 90 kinds: at most 8,100 bigrams reach the driver."""
    grams = words.select("word", F.explode(F.array_distinct(F.expr(
        "transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2))"))).alias("g"))
    counted = grams.groupBy("g").agg(F.count("*").alias("n")).collect()
    return {r.g: k for k, r in enumerate(sorted(counted, key=lambda r: (r.n, r.g)))}


def lookup_rows(words: DataFrame, ranks: dict[str, int], own: bool) -> DataFrame:
    """Keys of every word: with ``own`` those of its pivots, else those under
    which words of its length, one less or one more find its prefix."""
    from xxhash import xxh64_intdigest

    schema = "key long, last int, word string, n long" + (", place int, other_place int, kind string, parted int" if own else "")
    arrow = arrow_schema(words.sparkSession, schema)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                out: list[tuple] = []
                for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    places, chosen, last = signature(word, ranks)
                    size = len(word)
                    if own:
                        for p, before in ((chosen[0], None), (chosen[1], chosen[0])):
                            for kind, parted, key in keys_at(word, p, (size,)):
                                out.append((xxh64_intdigest(key) - (1 << 63), last, word, n, p, before, kind, parted))
                    else:
                        for p in places:
                            for _, _, key in keys_at(word, p, (size - 1, size, size + 1)):
                                out.append((xxh64_intdigest(key) - (1 << 63), last, word, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return words.select("word", "n").mapInArrow(rows, schema)


#: Agreement left of a pivot at place {p}, and from it on.
_LEFT = "substring(word, 1, {p} + 2) = substring(other, 1, {p} + 2)"
_RIGHT = "right(word, char_length(word) - {p}) = right(other, char_length(word) - {p})"
_PARTED = "left(word, parted) = left(other, parted)"


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every pair of words one edit apart, once."""
    ranks = gram_ranks(words)
    own = lookup_rows(words, ranks, True)
    other = lookup_rows(words, ranks, False).select(
        "key", F.col("last").alias("other_last"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    left, right = _LEFT.format(p="place"), _RIGHT.format(p="place")
    first = f"({_LEFT.format(p='other_place')} OR {_RIGHT.format(p='other_place')})"
    return own.join(other, "key").where(
        "(last < other_last OR (last = other_last AND word < other)) AND abs(char_length(word) - char_length(other)) <= 1 "
        f"AND CASE WHEN startswith(kind, 'L') THEN {left} AND (kind <> 'LB' OR NOT {_PARTED}) "
        f"ELSE {right} AND NOT {left} AND (kind <> 'RB' OR NOT {_PARTED}) END "
        f"AND (other_place IS NULL OR NOT {first}) AND levenshtein(word, other, 1) = 1"
    ).select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the last form reached."""
    up = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(JUMPS):
        step = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = written(up.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")),
                     "spelling-roots")
    return up


def group_spellings(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO,
                    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    if min_length < 4 or ratio < 2:
        raise ValueError("words need three bigrams and forms a larger count")
    words = written(words_of(docs, key, text, min_length, min_count), "spelling-words")
    found = near_words(words)
    both = F.array(F.struct("word", "other", "other_n"),
                   F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    near = found.select(F.explode(both).alias("p")).select("p.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top"))
    linked = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("top.less") >= ratio * F.col("n"), F.col("top.other")).alias("form"),
        F.when(-F.col("top.less") >= ratio * F.col("n"), -F.col("top.less")).alias("form_n")), "spelling-forms")
    last = roots(linked.where("form IS NOT NULL"))
    return linked.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
