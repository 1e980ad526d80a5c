"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from affinis.llm import (
    bitpack,
    boosted_quality,
    chat_format,
    decontaminate,
    license_scan,
    line_rules,
    nnpu_toxicity,
    shard_lpt,
    simhash,
    vector_pack,
)
from affinis.llm.common import read_table, smallest_hashes
from affinis.llm.tokenizing import TextEncoder

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "\n\n", "Release under  the MIT License!", "x " * 30000, "é ß 日本 😀 İ Σας", "<|endoftext|> it's", "tab\tand\x1cnul\x00"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, k string, shard string, fp string"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [(i, t, "en", "h" if i % 2 else None, 1, 0.0, "k", "s", "f") for i, t in enumerate(ODD)]
    rows += [(3, "a", None, None, None, None, None, None, None)] * 3 + [(None, "null id", None, "h", None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def every_operator(spark, docs):
    yes, none = F.lit(True), spark.createDataFrame([], "item_id long, text string")
    return {
        "shards": shard_lpt.shard_documents(docs), "licences": license_scan.digest(license_scan.scan_licenses(docs)),
        "quality": boosted_quality.score_documents(docs, labels(spark), yes), "lines": line_rules.judge(docs),
        "near": simhash.near_components(docs), "packed": bitpack.packed_ids(docs, BYTE, "byte", 2),
        "toxic": nnpu_toxicity.score_documents(docs, labels(spark), yes), "clean": decontaminate.scan(docs, none),
    }


def test_odd_rows_keep_their_number_and_empty_tables_stay_empty(spark):
    docs = odd_documents(spark)
    for name, out in every_operator(spark, docs).items():
        assert out.count() == docs.count(), name
    for name, out in every_operator(spark, docs.limit(0)).items():
        assert out.count() == 0, name
    assert vector_pack.pack_documents(docs.limit(0), WORD).count() == 0
    assert line_rules.clean(docs).columns == docs.columns and line_rules.clean(docs).count() == 0


def test_pipeline_on_odd_and_empty_documents(spark):
    import corpus_pipeline

    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.dtypes == docs.dtypes, name
            out.collect()


def test_dedup_keeps_different_texts_of_one_id_or_none(spark):
    import corpus_pipeline

    def text(k):
        return " ".join(f"w{k}x{i * (k + 3) % 97}" for i in range(80))

    rows = [(None, text(0)), (None, text(1)), (7, text(2)), (7, text(3)), (7, text(3)), (9, text(3)), (3, text(4)), (8, text(4))]
    docs = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()]
    assert len(out) == 5 and set(out) == {rows[i] for i in (0, 1, 2, 3, 6)}


def test_smallest_hashes_hold_the_sample(spark):
    ids = spark.range(50_000).withColumnRenamed("id", "doc_id")
    for limit in (1, 500, 60_000):
        some = smallest_hashes(ids, "doc_id", limit, 50_000)
        first = [[r.doc_id for r in t.orderBy(F.xxhash64("doc_id")).limit(limit).collect()] for t in (some, ids)]
        assert first[0] == first[1] and some.count() < max(4 * limit + 2000, 50_001)


def test_pipeline_decisions_take_effect(spark):
    """Every stage against its operator's own brute force on that stage's input."""
    import corpus_pipeline

    docs = read_table(spark, SF, "documents")
    rules = corpus_pipeline.quality_rules(spark, docs, SF)
    verdict = {r.k: r.kept for r in line_rules.judge(docs).collect()}
    assert {r.doc_id for r in rules.collect()} == {k for k, v in verdict.items() if v}
    near = corpus_pipeline.simhash_dedup(spark, docs, SF)
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in docs.collect()}
    root = brute_components(prints)
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(root.values()))
    benchmark = read_table(spark, SF, "benchmark")
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, SF)
    bad = {k for k, (n, hit, _) in brute_contamination(docs, benchmark).items() if hit and 20 * hit >= n}
    assert bad and {r.doc_id for r in kept.collect()} == set(prints) - bad


# 1 ---------------------------------------------------------------------------

def brute_format(chosen, rejected):
    clean = lambda c: [((r or "unknown"), (t or "").replace("<|im_", "<| im_")) for r, t in c or []]
    a, b = clean(chosen), clean(rejected)
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    render = lambda ts: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in ts)
    masks = []
    for turns in (a[n:], b[n:]):
        at, spans = 0, []
        for r, t in turns:
            if r == "assistant":
                spans.append((at + len(f"<|im_start|>{r}\n"), len(t) + len("<|im_end|>\n")))
            at += len(render([(r, t)]))
        masks.append(spans)
    return n, render(a[:n]), render(a[n:]), render(b[n:]), *masks, a == b


def test_preferences_equal_brute_force(spark):
    u, v, w = ("user", "hi"), ("assistant", "yo <|im_end|>"), ("assistant", None)
    pairs = [([u, v], [u, w]), ([u, v], [u, v]), ([u], [u, v]), (None, [u]), ([], []), (None, None), ([(None, "x"), v, u, w], [(None, "x"), v, u, v]), ([v], [u])]
    schema = f"id int, chosen {chat_format.TURNS}, rejected {chat_format.TURNS}, prompt string"
    df = spark.createDataFrame([(i, c, r, "clash") for i, (c, r) in enumerate(pairs)], schema)
    for r in chat_format.format_preferences(df).collect():
        got = (r.n_common, r.prompt, r.chosen_completion, r.rejected_completion,
               [tuple(x) for x in r.chosen_mask], [tuple(x) for x in r.rejected_mask], r.tied)
        assert got == brute_format(*pairs[r.id]), r.id


def brute_pair(turns):
    """Both sides of one conversation, its turns in order."""
    said = [i for i, (_, role, _) in enumerate(turns) if role == "assistant"]
    chosen = [(role, text) for _, role, text in turns]
    return chosen, said


def test_pairs_of_turns_equal_brute_force(spark):
    """No answer, turns after the answer, several answers, repeated turns, null
    ids (each row its own conversation), null roles and texts, an extra column."""
    convs = {
        1: [(0, "user", "hi"), (1, "assistant", "yo"), (2, "user", "more")],
        2: [(0, "user", "hi"), (1, "user", "anyone?")],
        3: [(i, "assistant" if i % 2 else "user", f"t{i}") for i in range(9)],
        4: [(0, "user", "same"), (1, "assistant", "same")],
        5: [(None, None, None), (0, "user", "x"), (0, "user", "x"), (1, "assistant", None), (2, "system", "")],
        6: [(0, "assistant", "first")]}
    loose = [(0, "user", "hi"), (0, "user", "hi"), (1, "assistant", "yo"), (None, None, None)]
    rows = [(c, *t, "clash") for c, ts in convs.items() for t in ts] + [(None, *t, "clash") for t in loose]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, chosen string")
    got = chat_format.pairs_from_turns(df).collect()
    assert chat_format.pairs_from_turns(df.limit(0)).count() == 0
    sides = lambda ts: [(t.role, t.text) for t in ts]
    assert sorted(str(sides(r.chosen)) for r in got if r.conv_id is None) == sorted(str([t[1:]]) for t in loose)
    assert len(got) == len(convs) + len(loose)
    for r in got:
        if r.conv_id is None:
            continue
        chosen, said = brute_pair(convs[r.conv_id])
        want = list(chosen)
        if said:
            at = said[int(hashlib.md5(str(r.conv_id).encode()).hexdigest()[:8], 16) % len(said)]
            want[at] = ("assistant", chosen[0][1])
        assert sides(r.chosen) == chosen and sides(r.rejected) == want, r.conv_id


# 2 ---------------------------------------------------------------------------

def test_schedule_is_longest_processing_time():
    jobs = [("a", 7), ("b", 7), ("c", 6), ("d", 5), ("e", 4), ("f", 4), ("g", 3)]
    plan = shard_lpt.schedule(jobs, 3)
    loads = [sum(s for j, s in jobs if plan[j] == k) for k in range(3)]
    assert sorted(loads) == [11, 11, 14] or max(loads) <= 4 / 3 * 36 / 3


def test_shards_keep_copies_together_and_slots_gapless(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 400} " + "y" * (i % 50)) for i in range(3000)]
    out = shard_lpt.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    out["text"] = [dict(rows)[k] for k in out.doc_id]
    assert (out.groupby("text").shard.nunique() == 1).all()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() < 0.05 * sums.mean()


# 3 ---------------------------------------------------------------------------

def test_fuzzy_notices_are_found_with_their_spans():
    scan = license_scan.Scanner().scan
    n, exact, spans = scan("Foo bar, Relased  under THE mit-license; end")
    assert n == 8 and exact == [(3, "mit")] and [(s.label, s.first_word, s.last_word, s.errors) for s in spans] == [("mit", 2, 6, 1)]
    n, exact, spans = scan("xx released under teh mit licence yy")
    assert not exact and [s.label for s in spans] == ["mit"] and spans[0].errors <= 3
    assert [s.label for s in scan("licensed under CC BY-SA 4.0")[2]] == ["cc-by-sa"]
    assert scan("nothing of the kind " * 50)[2] == [] and scan(None) == (0, [], [])


def test_every_window_within_the_edits_is_found():
    """Random edits of a notice up to its bound; the seeds lose none."""
    rng = np.random.default_rng(1)
    for notice, label in license_scan.NOTICES:
        k = license_scan.edits_allowed(notice)
        for _ in range(20):
            text = list(notice)
            for at in rng.choice(np.arange(1, len(text) - 1), k, replace=False):
                if text[at] != " ":
                    text[at] = "q"
            found = license_scan.Scanner([(notice, label)], []).scan("lorem ipsum " + "".join(text) + " dolor sit")[2]
            assert [s.label for s in found] == [label], "".join(text)


def brute_spans(words, notice, k):
    """(errors, first word, last word) of notices, by edit distance of every run
    of words; of runs that share words the one with the fewest errors."""
    found = []
    for a in range(len(words)):
        for b in range(a, len(words)):
            run = " ".join(words[a:b + 1])
            if len(run) > len(notice) + k:
                break
            if len(run) >= len(notice) - k:
                row = list(range(len(notice) + 1))
                for i, x in enumerate(run, 1):
                    left, row[0] = row[0], i
                    for j, y in enumerate(notice, 1):
                        left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
                if row[-1] <= k:
                    found.append((row[-1], a, b))
    taken = []
    for e, a, b in sorted(found):
        if all(b < c or d < a for _, c, d in taken):
            taken.append((e, a, b))
    return sorted(taken, key=lambda t: t[1])


def test_neighbouring_notices_are_all_found():
    """Several damaged notices in one text, some before a better one, against brute force."""
    notice, label = license_scan.NOTICES[1]
    scan = license_scan.Scanner([(notice, label)], []).scan
    damaged = "licensd undr the apache license version 2"
    assert [s.errors for s in scan(" ".join([damaged] * 5 + [notice]))[2]] == [2] * 5 + [0]
    rng = np.random.default_rng(5)
    k = license_scan.edits_allowed(notice)
    for _ in range(40):
        words = []
        for _ in range(rng.integers(2, 6)):
            text = list(notice)
            for at in rng.choice(np.arange(1, len(text) - 1), rng.integers(0, k + 1), replace=False):
                if text[at] != " " and text[at - 1] != " " and text[at + 1] != " ":
                    text[at] = ("q", "")[rng.integers(2)]
            words += ["apache", "lorem", "license"][:rng.integers(0, 4)] + "".join(text).split()
        got = [(s.errors, s.first_word, s.last_word) for s in scan(" ".join(words))[2]]
        assert got == brute_spans(words, notice, k), " ".join(words)


# 4, 8 --------------------------------------------------------------------------

def test_flat_trees_walk_like_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    m = boosted_quality.grow(x, y, trees=20)

    def walk(row, node):
        while m.left[node] != node:
            node = m.left[node] if row[m.feature[node]] <= m.threshold[node] else m.right[node]
        return m.value[node]

    slow = [m.base + sum(walk(r, t) for t in m.roots) for r in x[:50]]
    assert np.allclose(m.margin(x[:50]), slow) and ((m.score(x) >= 0.5) == y).mean() > 0.95
    assert boosted_quality.grow(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_on_held_out_labels(spark):
    from affinis.llm.queries import op4_quality_trees

    sf = "/root/testdata/sf0.01"
    both = op4_quality_trees(spark, sf).where("held_out").join(read_table(spark, sf, "labels"), "doc_id").toPandas()
    assert (both.predicted == both.quality).mean() > 0.95 and both.score.between(0, 1).all()


def test_nnpu_separates_with_unlabelled_positives():
    """10 % of U is positive and carries words 0-4, one or more; noise words 5-19 say nothing."""
    rng = np.random.default_rng(2)
    toxic = lambda: sorted({int(rng.integers(5)), *rng.integers(5, 20, 4).tolist()})
    fine = lambda: sorted(set(rng.integers(5, 20, 4).tolist()))
    p, u = [toxic() for _ in range(300)], [toxic() if i % 10 == 0 else fine() for i in range(3000)]
    w, b = nnpu_toxicity.fit(p, u, 20, 0.1)
    calls = [(sum(w[j] for j in d) + b >= 0, min(d) < 5) for d in u]
    assert np.mean([c == t for c, t in calls]) > 0.98


# 5 ---------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\t#é0", max_size=80))
def test_text_figures(text):
    import re

    f = line_rules.text_figures(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"]) == (
        len(words), sum(map(len, words)), text.count("#"), len(lines) - len(set(lines)), len(hit))


def test_boilerplate_goes_copies_do_not(spark):
    """A menu line on every page of a host goes, a page of menu lines is depleted,
    and forty copies of one page are no template."""
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are all alike in a normalised line
    word = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n)).translate(letters)
    menu, foot = "Home About Contact 2021", word(999, 80)
    rows = [(i, f"{menu}\n{word(i, 60)}\n{word(i + 500, 20)}", "a") for i in range(40)]
    rows += [(100 + i, f"{word(900, 60)}\n{word(901, 60)}", "b") for i in range(40)]
    rows += [(200 + i, f"{word(300 + i, 60)}", "b") for i in range(40)] + [(300 + i, f"{foot}\n{word(700 + i, 60 - 55 * (i == 0))}", "c") for i in range(40)]
    docs = spark.createDataFrame([(k, t, h, len(t), 1) for k, t, h in rows], "doc_id long, text string, source string, n_chars long, removed int")
    limits = {"min_docs": 10, "min_share": 0.2}
    for broadcast in (10**6, 0):
        got = {r.k: r for r in line_rules.judge(docs, **limits, broadcast_lines=broadcast).collect()}
        assert {k for k, r in got.items() if not r.kept} == {300} and got[0].n_removed_words == 4 and got[100].n_removed_words == 0
    out = {r.doc_id: r for r in line_rules.clean(docs, **limits).collect()}
    assert set(out) == {k for k, _, _ in rows} - {300}
    assert out[5].text == f"{word(5, 60)}\n{word(505, 20)}" and out[5].n_chars == len(out[5].text) and out[100].text == rows[40][1]


def test_template_of_many_lines_is_found(spark):
    """Pages of twenty shared and two own lines are as many documents as there
    are pages, exact copies of one of them are one."""
    letters = str.maketrans("0123456789", "abcdefghij")
    line = lambda i, n=4: " ".join(f"w{i}x{j}" for j in range(n)).translate(letters)
    shared = [line(9000 + j) for j in range(20)]
    rows = [(i, "\n".join([*shared, line(2 * i), line(2 * i + 1)]), "a") for i in range(100)]
    rows += [(1000 + i, rows[0][1], "a") for i in range(30)]
    rows += [(2000 + i, "\n".join(line(20000 + 15 * i + j) for j in range(15)), "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {t for _, t, _ in rows}
    holds = {x: sum(x in t.split("\n") for t in texts) for t in texts for x in t.split("\n")}
    found = {r.line: r.n_docs for r in line_rules.frequent_lines(line_rules.figures(docs)).collect()}
    assert found == {line_rules.line_hash(x.encode().split()): n for x, n in holds.items() if n >= 25} and len(found) == 20
    assert {r.k for r in line_rules.judge(docs).collect() if not r.kept} == {k for k, _, _ in rows if k < 2000}


def test_large_host_hides_no_boilerplate(spark):
    """A line in five distinct documents goes from a host of a thousand, one in
    four stays; a page of such lines is depleted; ``many_docs`` raises the limit."""
    letters = str.maketrans("0123456789", "abcdefghij")
    line = lambda i, n=60: " ".join(f"w{i}x{j}" for j in range(n)).translate(letters)
    five, four = line(5000), line(5001)
    more = {i: [five] * (i < 5) + [four] * (i < 4) for i in range(1000)}
    rows = [(i, "\n".join([*more[i], line(i, 60 - 50 * (i == 4))]), "a") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.k: r for r in line_rules.judge(docs).collect()}
    assert {k: r.n_removed_words for k, r in got.items() if r.n_removed_words} == dict.fromkeys(range(5), 60)
    assert {k for k, r in got.items() if not r.kept} == {4}
    assert not any(r.n_removed_words for r in line_rules.judge(docs, many_docs=10).collect())


# 6 ---------------------------------------------------------------------------

def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_by_definition():
    for text in ["", "One two", "a b c d", "A b  c d e\nf g a b c d", "é " * 9, None]:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


def test_anchors_meet_for_every_pair_within_distance():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    at = []
    for fps in (a, b):
        sets, homes = [set() for _ in fps], [set() for _ in fps]
        for r, k, h in zip(*simhash.anchors(fps), strict=True):
            sets[r].add(int(k))
            if h:
                homes[r].add(int(k))
        at.append((sets, homes))
    assert all(at[0][1][i] & at[1][0][i] and at[1][1][i] & at[0][0][i] for i in range(len(a)))


@pytest.mark.parametrize("homes_per_cell", [4096, 3])
def test_components_equal_brute_force(spark, homes_per_cell):
    """A chain, a dense ball, far ones; cells split or not."""
    rng = np.random.default_rng(4)
    fps, x = [], 0x0123456789ABCDEF
    for _ in range(25):
        x ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        fps.append(x)
    fps += [0xFFFF0000FFFF0000 ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(60)]
    fps += [int(v) for v in rng.integers(0, 1 << 63, 60, dtype=np.uint64)] + fps[:5]
    prints = dict(enumerate(fps))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in sorted(set(fps))]
    edges = simhash.connected(simhash.links(spark.createDataFrame(signed, "fp long"), homes_per_cell=homes_per_cell)).collect()
    up = {e.node % (1 << 64): e.root % (1 << 64) for e in edges}
    want = brute_components(prints)
    for i in prints:
        for j in prints:
            assert (up.get(fps[i], fps[i]) == up.get(fps[j], fps[j])) == (want[i] == want[j])


# 7, 9 --------------------------------------------------------------------------

@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZé 0.,'s\n\t  \x1cİΣ日😀<|>-́")), max_size=40))
def test_encoder_equals_the_library(text):
    for enc, tok in zip(ENCODERS, LIBRARY, strict=True):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "\n", "it's", "Éa", "日"]), max_size=9))
def test_special_strings_are_read_as_the_library_reads_them(parts):
    test_encoder_equals_the_library.hypothesis.inner_test("".join(parts))


def test_special_string_example():
    assert np.frombuffer(ENCODERS[0].encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


LIBRARY = [Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)]
ENCODERS = [TextEncoder(BYTE, "byte", 200), TextEncoder(WORD, "word", 200)]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 40), max_size=30), st.integers(1, 50))
def test_packed_file_round_trip(bits, sizes, block):
    rng = np.random.default_rng(bits)
    docs = [(None if i == 0 else i, rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)) for i, n in enumerate(sizes)]
    out = io.BytesIO()
    w = bitpack.Writer(out, bits, block)
    for doc, ids in docs:
        w.add(doc, ids)
    w.close()
    r = bitpack.Reader(out, out.tell())
    assert [(d, i.tolist()) for d, _, i in r.documents()] == [(d, i.tolist()) for d, i in docs]
    whole = np.concatenate([i for _, i in docs]) if docs else np.zeros(0, np.uint32)
    a, b = sorted(rng.integers(0, len(whole) + 1, 2).tolist())
    assert r.ids(a, b).tolist() == whole[a:b].tolist()


def test_packed_ids_of_documents(spark):
    docs = odd_documents(spark).where("doc_id is null or doc_id != 6")
    tok, at = Tokenizer.from_file(BYTE), 0
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    got = sorted(bitpack.packed_ids(docs, BYTE, "byte", 2).collect(), key=lambda r: r.start)
    for r, g in zip(rows, got, strict=True):
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("cap", [
    vector_pack.Capacity(100, 100, 10_000), vector_pack.Capacity(100, 4, 10_000), vector_pack.Capacity(100, 100, 6_500),
    vector_pack.Capacity(100, 3, 6_500, (1.0, 0.5, 0.5), "dot")])
def test_bins_hold_every_capacity(cap):
    lengths = np.sort(np.random.default_rng(5).integers(1, 80, 400))[::-1]
    bins = vector_pack.best_fit(lengths, cap)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= cap.tokens and len(own) <= cap.documents and (own**2).sum() <= cap.attention
    bound = max(lengths.sum() / cap.tokens, len(lengths) / cap.documents, (lengths**2).sum() / cap.attention)
    assert len(np.unique(bins)) <= 1.25 * bound + 1


def test_packing_is_whole_and_sequences_can_be_made(spark):
    docs = odd_documents(spark)
    parts = vector_pack.pieces(docs, WORD, "word", 1, 64, with_ids=True)
    placed = vector_pack.place(parts.drop("ids"), vector_pack.Capacity(64, 64, 64 * 64), group_sequences=50)
    assert placed.count() == parts.count()
    for _, g in placed.toPandas().groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 64 and g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
    made = vector_pack.sequences(placed, parts).collect()
    assert all(len(r.ids) == sum(r.piece_lengths) for r in made)
    assert sum(len(r.ids) for r in made) == parts.agg(F.sum("length")).first()[0]


def test_equal_pieces_are_dealt_over_groups(spark):
    """Three thousand equal rows, ids null or not, do not gather in one group."""
    rows = [(None, 0, 0, 64, 7)] * 3000 + [(5, 0, 0, 64, 8)] * 3000 + [(i, 0, 0, 1 + i % 60, i) for i in range(100, 400)]
    parts = spark.createDataFrame(rows, vector_pack.PIECE)
    cap = vector_pack.Capacity(64, 64, 64 * 64)
    placed = [sorted(map(tuple, vector_pack.place(p, cap, group_sequences=100).fillna(-1).collect()))
              for p in (parts, parts.orderBy(F.desc("ids_crc32")))]
    assert placed[0] == placed[1] and [p[:5] for p in placed[0]] == sorted((-1 if r[0] is None else r[0], *r[1:]) for r in rows)
    sizes = np.unique([p[5] >> 32 for p in placed[0]], return_counts=True)[1]
    assert sizes.size > 30 and sizes.max() < 600


# 10 --------------------------------------------------------------------------

def brute_contamination(docs, benchmark, n=13):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    table = {}
    for r in benchmark.collect():
        w = words(r.text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            table.setdefault(tuple(w[i:i + n]), set()).add(str(r.item_id))
    out = {}
    for r in docs.collect():
        w, hit, items = words(r.text), set(), set()
        for size in {len(k) for k in table}:
            for i in range(len(w) - size + 1):
                if (found := table.get(tuple(w[i:i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    items |= found
        out[r.doc_id] = (len(w), len(hit), sorted(items))
    return out


@pytest.mark.parametrize("max_windows", [200_000, 0])
def test_decontamination_by_set_and_by_join(spark, max_windows):
    item = " ".join(f"Word{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "Short item, here"), (3, None), (4, ""), (10, item + " tail"), (11, "aa aa")], "item_id long, text string")
    texts = [item, "x " * 300 + item, "short ITEM here", "aa aa aa aa", None, "", item[:40], item + " y " + item, " ".join(f"z{i}" for i in range(5000))]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, item, "clash")], "doc_id long, text string, n_words string")
    got = decontaminate.scan(docs, bench, max_windows=max_windows).collect()
    want = brute_contamination(docs, bench)
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == want[r.doc_id] and r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    left = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench, max_windows=max_windows).collect()}
    assert left[0] == "" and left[1] == " ".join(["x"] * 300) and left[7] == "y" and left[4] is None


def test_decontamination_plan_is_native(spark):
    docs, bench = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    plan = decontaminate.scan(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange", "Join"))


def test_clean_keeps_null_hosts_apart_and_takes_any_column_name(spark):
    line = "the same line of eight words in all\n"
    rows = [(i, line + ("abcdefghijk"[i] * 5 + " ") * 60, h, i, "x", "y", "z") for i, h in enumerate([None] * 3 + [""] * 3 + ["h"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _k long, _h string, _t string, _removed string")
    out = {r.k: r.n_removed_words for r in line_rules.judge(docs).collect()}
    assert out == {i: 8 if i >= 6 else 0 for i in range(11)}
    assert line_rules.clean(docs).dtypes == docs.dtypes
    import corpus_pipeline

    assert corpus_pipeline.simhash_dedup(spark, docs.withColumnsRenamed({"_h": "lang", "_k": "n_chars", "_removed": "_n"}), SF).count() > 0


def test_scan_of_a_long_text_numbers_words_as_counting_does():
    scanner = license_scan.Scanner()
    notice = "Released under the MIT license. Café été. licensd under the apache license version 2! all rights reserved "
    n, exact, spans = scanner.scan(notice * 200)
    words = (notice * 200).lower().replace(".", " ").replace("!", " ").split()
    assert n == len(words)
    assert sorted(exact) == sorted(
        (i, label) for phrase, label in license_scan.BASE for p in [phrase.split()]
        for i in range(len(words)) if words[i:i + len(p)] == p)
    assert len(spans) == 600 and [s.first_word for s in spans[:3]] == [0, 7, 14]
    assert all(b.first_word - a.first_word == len(words) // 200 for a, b in zip(spans, spans[3:], strict=False))


def test_ids_of_whole_bytes_are_not_taken_apart(monkeypatch):
    """Ids of 8, 16, 24 bits are cut from their bytes; the string is the bitwise one."""
    import numpy as np

    from affinis.llm import bitpack

    ids = np.array([0, 1, 255, 77], np.uint32)
    bitwise = np.packbits(np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=16, bitorder="little").ravel(),
                          bitorder="little").tobytes()

    def never(*a, **k):
        raise AssertionError("taken apart")

    monkeypatch.setattr(bitpack.np, "unpackbits", never)
    assert bitpack.pack(ids, 16) == bitwise
    for bits in (8, 16, 24):
        assert (bitpack.unpack(bitpack.pack(ids, bits), bits, len(ids)) == ids).all()
        assert bitpack.unpack(bitpack.pack(ids[:0], bits), bits, 0).size == 0
