import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkstrata.llm import neardup
from sparkstrata.llm.graph import components
from sparkstrata.llm.neardup import near_duplicates
from sparkstrata.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, key string, component_id long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < n else frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(docs, n, percent=80):
    """The components of ids; an id with several texts is one node."""
    sets = {}
    for i, t in docs:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, n))
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i][0]), find(i)) for i in ids}


def corpus(seed, sizes, edits, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    docs = []
    for size in sizes:
        base = [rng.choice(words) for _ in range(size)]
        docs.append(base)
        for rate in edits:
            docs.append([rng.choice(words) if rng.random() < rate else w for w in base])
    texts = [" ".join(d) for d in docs]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def check(spark, docs, n=4):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    rows = near_duplicates(df, Scratch(spark, "t"), shingle_words=n).collect()
    assert len(rows) == len(docs)
    want = brute(docs, n)
    for r in rows:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id][1], r
            assert r.n_shingles == len(shingles(dict(docs)[r.doc_id], n)) or [i for i, _ in docs].count(r.doc_id) > 1
            assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    sizes = [3, 5, 6, 8, 12, 15, 18, 20, 30, 60, 125, 300, 700]
    check(spark, corpus(seed, sizes * 2, [0.0, 0.002, 0.01, 0.02, 0.03, 0.05]))


def test_one_large_group_near_the_threshold(spark):
    check(spark, corpus(3, [150], [0.006] * 60 + [0.02] * 40))


def test_small_sets_at_the_threshold_always_meet(spark):
    """Pairs of texts whose sets have 4 in 5, 5 in 6, 8 in 10 and 16 in 20 shingles in common."""
    rng, docs = random.Random(8), []
    for k in range(400):
        size = (7, 8, 11, 19)[k % 4]
        text = [f"u{rng.randrange(10**6)}" for _ in range(size)]
        docs += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text, "more"]))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA), Scratch(spark, "t"), shingle_words=4).collect()}
    assert got == {i: i - i % 2 for i, _ in docs}


def test_repeated_ids_with_different_texts(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(30)) for x in "abc")
    check(spark, [(1, a), (5, a), (2, b), (5, b), (7, c), (8, c + " tail"), (8, ""), (9, None), (9, "")])
    got = {(r.doc_id, r.n_shingles > 0): r.component_id for r in near_duplicates(spark.createDataFrame([(8, "", "x", 1), (8, c, "x", 1), (3, c, "x", 1)], SCHEMA), Scratch(spark, "t")).collect()}
    assert set(got.values()) == {3}


def test_edge_cases(spark):
    long_text = " ".join(f"z{i % 997}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long_text), (8, long_text + " tail"), (9, "é È é È é"), (10, "É È é È é")]
    check(spark, docs)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e f", "x", 1), (None, "a b c d e f", "x", 1), (5, "a b c d e f", "x", 1), (5, "a b c d e f", "x", 1), (9, "a b c d e f", "x", 1)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"), 4).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (5, 5, True), (5, 5, True), (9, 5, False)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"), 4).collect() == []


def test_registers_hold_leading_zeros_and_mantissa():
    value = np.array([(3 << 57) | (1 << 50) | (0b1100110011 << 40)], np.uint64)
    regs = neardup.registers(np.array([0]), value, 1)
    assert np.flatnonzero(regs[0]).tolist() == [3]
    # After the 7 bucket bits: 6 zeros, the leading one, then the mantissa.
    assert int(regs[0, 3]) == 1 + (6 << 10) + 0b1100110011


@given(st.integers(0, 10_000), st.floats(0.81, 1.0))
@settings(max_examples=30, deadline=None)
def test_estimate_passes_similar_sets(seed, similarity):
    rng = np.random.default_rng(seed)
    some = lambda k: rng.integers(0, np.iinfo(np.uint64).max, k, dtype=np.uint64)
    both = some(1000)
    extra = int(1000 / similarity) - 1000
    a, b = (np.unique(np.concatenate([both, some(extra // 2)])) for _ in range(2))
    regs = [neardup.registers(np.zeros(len(x), np.int64), x, 1) for x in (a, b)]
    n = [np.array([len(x)]) for x in (a, b)]
    assert neardup.plausible(*regs, *n, 0.8)[0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (3, 1), (4, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).collect() == []
