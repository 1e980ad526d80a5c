"""Operators 11 to 13 against brute force on whole small tables, and odd inputs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from affinis.llm import bottomk, hard_negatives, queries, spelling
from affinis.llm.common import read_table

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "one two three", "\n\n", "x " * 30000, "wordword" * 4000, "é ß 日本 😀 İ Σας",
       "tab\tand\x1cnul\x00 misspelled mispelled", "ÀÉÎÕÜabc ÀÉÎÕÜabc"]
COLUMNS = ("doc_id long, text string, n long, node long, word string, label int, held string, component_id string, "
           "value int, form string, root int, grp int")


def odd_documents(spark):
    rows = [(i, t, 1, 2, "w", 3, "h", "c", 4, "f", 5, 6) for i, t in enumerate(ODD)]
    rows += [(4, "one two three", *[None] * 10)] * 3 + [(None, "one two three", *[None] * 10), (None, None, *[None] * 10)]
    return spark.createDataFrame(rows, COLUMNS)


# 11 --------------------------------------------------------------------------

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[i:] == b[i + 1:]


def brute_spelling(docs, ratio=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    meet = defaultdict(set)
    for w in n:
        if len(w) < 200:
            meet[w].add(w)
            for i in range(len(w)):
                meet[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for ws in meet.values():
        for a in ws:
            near[a] |= {b for b in ws if one_edit(a, b)}
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_spelling_equals_brute_force(spark, sf):
    found = spelled(queries.op11_spelling_groups(spark, f"/root/testdata/{sf}"))
    docs = [(r.doc_id, r.text) for r in read_table(spark, f"/root/testdata/{sf}", "documents").collect()]
    assert found == brute_spelling(docs)


def test_spelling_chains_ties_and_accents(spark):
    words = {"committee": 2000, "comittee": 200, "comitee": 20, "comite" "x": 2, "ÀÉÎÕÜabc": 40, "ÀÉÎÕÜab": 4, "ÀÉÎÕÜabd": 40,
             "aaaaaaaa": 30, "aaaaaaaaa": 3, "abababab": 50, "ababababa": 5, "babababa": 50, "¡notaword!": 9}
    docs = [(k, " ".join([w] * c)) for k, (w, c) in enumerate(words.items())]
    docs += [(None, "nullidword nullidword"), (77, None), (78, ""), (79, "z" * 5000 + " " + "z" * 5000 + " " + "z" * 4999)] * 2
    found = spelled(spelling.group_spellings(spark.createDataFrame(docs, "doc_id long, text string")))
    want = brute_spelling(docs)
    long_ = {w for w in found if len(w) > 200}
    assert {w: found[w] for w in found.keys() - long_} == {w: v for w, v in want.items() if len(w) <= 200}
    assert long_ == {w for w in want if len(w) > 200}
    assert any(v[1] == "committee" and v[0] != "committee" and w != v[1] for w, v in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=3, max_size=12, unique=True), st.data())
def test_pivots_are_the_cheapest_disjoint_pair(places, data):
    places = sorted(places)
    cost = data.draw(st.lists(st.integers(1, 50), min_size=len(places), max_size=len(places)))
    price = dict(zip(places, cost, strict=True))
    best = min(price[a] + price[b] for a in places for b in places if b - a >= 2)
    a, b = spelling.pivots(places, cost)
    assert b - a >= 2 and price[a] + price[b] == best


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", min_size=7, max_size=11), st.integers(0, 10), st.sampled_from("abcdx"), st.integers(0, 2), st.data())
def test_a_pivot_of_one_word_stands_in_the_prefix_of_its_near_word(word, at, letter, kind, data):
    at %= len(word)
    other = [word[:at] + word[at + 1:], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1:]][kind]
    if not one_edit(word, other) or len(other) < 7:
        return
    grams = sorted({g for w in (word, other) for g in (w[i:i + 2] for i in range(len(w) - 1))})
    ranks = {g: i for i, g in enumerate(data.draw(st.permutations(grams)))}
    (pre_a, piv_a, last_a), (pre_b, piv_b, last_b) = spelling.signature(word, ranks), spelling.signature(other, ranks)
    if (last_b, other) < (last_a, word):
        word, other, piv_a, pre_b = other, word, piv_b, pre_a
    asked = {k for p in piv_a for *_, k in spelling.keys_at(word, p, (len(word),))}
    size = len(other)
    assert asked & {k for p in pre_b for *_, k in spelling.keys_at(other, p, (size - 1, size, size + 1))}


def test_every_pair_is_found_once(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("aab") for _ in range(rng.randrange(7, 10))) for _ in range(150)}
    words |= {w[:i] + w[i + 1:] for w in sorted(words)[:40] for i in range(len(w)) if len(w) > 7}
    words |= {"x" * 40 + w for w in sorted(words)[:30]} | {w + "y" * 40 for w in sorted(words)[:30]}
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    found = Counter(tuple(sorted((r.word, r.other))) for r in spelling.near_words(df).collect())
    assert set(found) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)} and set(found.values()) == {1}


# 12 --------------------------------------------------------------------------

def brute_shingles(text, words=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if not ws:
        return set()
    return {" ".join(ws[i:i + words]) for i in range(max(1, len(ws) - words + 1))}


def brute_near(docs, percent=85):
    """doc index -> (set size, smallest id reachable)."""
    sets = [brute_shingles(t) for _, t in docs]
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    shared = Counter()
    for ids in lists.values():
        shared.update((a, b) for x, a in enumerate(ids) for b in ids[x + 1:])
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            up[root(a)] = root(b)
    least = defaultdict(list)
    for i, (k, _) in enumerate(docs):
        least[root(i)].append(k)
    return sorted(((k, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None))
                   for i, (k, _) in enumerate(docs)), key=str)


def near_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_bottomk_equals_brute_force(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = [(r.doc_id, r.text) for r in read_table(spark, f"/root/testdata/{sf}", "documents").collect()]
        df = queries.op12_bottomk_components(spark, f"/root/testdata/{sf}")
        assert near_rows(df) == brute_near(docs)
        assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at] = f"e{rng.randrange(10 ** 6)}"
    return words


def test_bottomk_loses_no_link_of_crowded_lists(spark, monkeypatch):
    """Near copies of every degree, a passage that all documents hold, short texts,
    and blocks so small that a list spans many."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(90)]
    docs = []
    for _ in range(12):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice([4, 8, 30, 60, 200, 400]))]
        for _ in range(30):
            docs.append(edited(rng, base, rng.choice([0, 0, 1, 2, 3, 5, 8]) * len(base) // 100 + rng.choice([0, 1])))
    docs += [passage + [f"o{k}x{i}" for i in range(rng.choice([6, 12, 25, 60]))] for k in range(60)]
    rng.shuffle(docs)
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    want = brute_near(rows)
    assert 20 < len({c for _, _, c in want}) < 300
    monkeypatch.setattr(bottomk, "BLOCK", 8)
    monkeypatch.setattr(bottomk.across, "__defaults__", (8,))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert near_rows(bottomk.near_sets(df)) == want


def test_union_sketch_is_the_bottom_of_the_union():
    rng = np.random.default_rng(3)
    sets, size = [], 1200
    for _ in range(60):
        pool = np.unique(rng.integers(-2 ** 31, 2 ** 31, size))
        core = rng.choice(pool, rng.integers(1, size - 100), replace=False)
        sets += [np.unique(np.r_[core, rng.choice(pool, rng.integers(0, 120), replace=False)]) for _ in range(2)]
    held = np.full((len(sets), bottomk.K), bottomk._PAD)
    for row, s in zip(held, sets, strict=True):
        row[:min(bottomk.K, s.size)] = s[:bottomk.K]
    n = np.array([s.size for s in sets])
    passed = set(zip(*bottomk.possible(held, held, n, n, 85), strict=True))
    near = 0
    for i in range(0, len(sets), 2):
        a, b = sets[i], sets[i + 1]
        got = bottomk.overlaps(held[i:i + 1], held[i + 1:i + 2], n[i:i + 1], n[i + 1:i + 2], 85)[0]
        both, union = np.intersect1d(a, b), np.union1d(a, b)
        found = np.isin(union[:bottomk.K], both).sum()
        if max(a.size, b.size) <= bottomk.K:
            assert (got >= 0) == (100 * both.size >= 85 * union.size) == ((i, i + 1) in passed)
        elif 100 * min(a.size, b.size) >= 85 * max(a.size, b.size):
            assert got == (found if found >= bottomk.NEED else -1)
        near += got >= 0
        assert got < 0 or (i, i + 1) in passed
    assert 5 < near < 55


# 13 --------------------------------------------------------------------------

def brute_negatives(rows, every=100, positives=5, negatives=10, low=30, high=90):
    good = [(k, g, [int(np.floor(256.0 * float(x))) for x in v]) for k, v, g in rows
            if k is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = []
    for k, g, q in {(k, g, tuple(q)) for k, g, q in good if k % every == 0}:
        ranked = sorted(((-score(q, o), j, h) for j, h, o in good), key=lambda r: r[:2])
        for ps, j, _ in [r for r in ranked if r[2] == g and r[1] != k][:positives]:
            band = [r for r in ranked if r[2] != g and low * -ps <= -100 * r[0] <= high * -ps][:negatives]
            out += [(k, j, n, b[1], -ps, -b[0]) for n, b in enumerate(band, 1)]
    return sorted(out)


def mined(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def moved(rows):
    return [(k, v, (g + 1) % 10 if g is not None and k % 7 == 0 else g) for k, v, g in rows]


def test_hard_negatives_equal_brute_force(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = [(r.vec_id, r.embedding, r.label) for r in read_table(spark, f"/root/testdata/{sf}", "embeddings").collect()]
        want = brute_negatives(moved(rows))
        assert want and mined(queries.op13_hard_negatives(spark, f"/root/testdata/{sf}")) == want


def test_hard_negatives_of_odd_rows_in_many_cells(spark):
    rng = random.Random(2)
    rows = [(k, [round(rng.gauss(0, 1), 1) for _ in range(3)], k % 3) for k in range(500)]
    rows += [(k, [1.0, 1.0, 0.0], 1) for k in range(500, 620)]  # ties
    rows += [(700, None, 1), (701, [1.0, None, 2.0], 1), (702, [float("nan")] * 3, 1), (703, [1.0, float("inf"), 0.0], 0),
             (704, [1.0, 1.0, 1.0], None), (None, [9.0, 9.0, 9.0], 1), (800, [2.0], 0), (900, [], 1), (1000, [0.0, 0.0, 0.0], 2),
             (1100, [1e6, -1e6, 5e5], 2), (1100, [1e6, -1e6, 5e5], 2), (1200, [0.3, 0.1, 0.2], 0), (1200, [0.1, 0.1, 0.2], 1)]
    df = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows],
                               "vec_id long, embedding array<double>, label int, cluster string, aid int, id int, q int")
    want = brute_negatives(rows, every=20)
    for per_group, per_segment in ((2048, 8192), (7, 40)):
        assert mined(hard_negatives.mine_hard_negatives(df, every=20, anchors_per_group=per_group,
                                                        candidates_per_segment=per_segment)) == want
    assert mined(hard_negatives.mine_hard_negatives(df.limit(0))) == []


def test_walk_ends_early_and_bounds_hold():
    rng = np.random.default_rng(1)
    heads = rng.normal(size=(12, 24))
    pick = rng.integers(0, 12, 4000)
    x = np.floor(256 * (heads[pick] + 0.2 * rng.normal(size=(4000, 24)))).astype(np.int64)
    a = x[:200]
    centres = hard_negatives.fit_centroids(hard_negatives.directions(a)[0], 14)
    own = np.argmax(hard_negatives.directions(a)[0] @ centres.T, axis=1)
    ux, nx = hard_negatives.directions(x)
    for c in np.unique(own):
        b = hard_negatives.bounds(centres[c], hard_negatives.directions(a[own == c])[0], ux, nx)
        assert (hard_negatives.directions(a[own == c])[0] @ x.T <= b[None, :] + 1e-6).all()
    best = hard_negatives.Best(200, 5)
    met = hard_negatives.walk(a, x, centres, own, lambda r: best.score[r, -1],
                              lambda r, part, s: best.add(r, s, part, np.ones(s.shape, bool)))
    want = -np.sort(-(a @ x.T), axis=1)[:, :5]
    assert (best.score == want).all() and met < 0.5 * 200 * 4000


# odd inputs ------------------------------------------------------------------

def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert near_rows(bottomk.near_sets(docs)) == brute_near(rows)
    assert set(spelled(spelling.group_spellings(docs))) == set(brute_spelling(rows))
    assert bottomk.near_sets(docs.limit(0)).count() == 0 and spelling.group_spellings(docs.limit(0)).count() == 0
    only_null = docs.where(F.col("text").isNull())
    assert bottomk.near_sets(only_null).count() == only_null.count() == 2
