import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkstrata.llm.decontaminate import Matcher, drop_leaks, find_leaks, myers, normalise, pieces

SCHEMA = "doc_id long, text string, item_id string, distance int"


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return min(row)


@given(st.text("ab c", min_size=1, max_size=90), st.text("ab c", max_size=120))
@settings(max_examples=200, deadline=None)
def test_myers_is_the_edit_distance(pattern, text):
    assert myers(pattern, text)[0] == slow_distance(pattern, text)


@given(st.text("xyz", min_size=1, max_size=60), st.integers(0, 9))
def test_pieces_make_up_the_item(item, errors):
    cut = pieces(item, errors)
    assert "".join(p for _, p in cut) == item and all(item[a : a + len(p)] == p for a, p in cut) and len(cut) == errors + 1


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        rng.choice([lambda a: out.__setitem__(a, "q"), lambda a: out.pop(a), lambda a: out.insert(a, "q")])(at)
    return "".join(out)


def sample(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(12)]
    docs = []
    for i in range(60):
        parts = [word() for _ in range(40)]
        if i % 3 == 0:
            k, text = items[rng.randrange(12)]
            parts.insert(rng.randrange(40), edited(rng, text, rng.randrange(0, 9)))
        docs.append((i, rng.choice([" ", "\n  "]).join(parts).upper() if i % 2 else " ".join(parts)))
    return items, docs


@pytest.mark.parametrize("passes", [10**6, 900])
def test_finds_what_brute_force_finds(spark, passes):
    items, docs = sample(4)
    want = {}
    for d, t in docs:
        for i, x in items:
            distance = slow_distance(normalise(x), normalise(t))
            if distance <= int(0.05 * len(normalise(x))):
                want[d, i] = distance
    df = spark.createDataFrame([(d, t, "x", 9) for d, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in find_leaks(df, bench, max_pass_chars=passes).collect()}
    assert got == want and want
    kept = {r.doc_id for r in drop_leaks(df, bench, max_pass_chars=passes).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "a", 1), (None, "the quick brown fox jumps", "a", 1), (3, "", "a", 1), (4, "The  quick\nbrown fox jumps" + " pad" * 50_000, "a", 1), (4, "clean", "a", 1)], SCHEMA)
    bench = spark.createDataFrame([(1, "quick brown fox"), (2, None), (3, "  "), (None, "clean"), (1, "brown fox")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in find_leaks(df, bench).collect())
    assert got == [(0, 1, 0), (4, 1, 0)]
    assert drop_leaks(df, bench).columns == df.columns and drop_leaks(df, bench).count() == 3
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(df, none).collect() == [] and drop_leaks(df, none).count() == 5
    assert find_leaks(df.limit(0), bench).collect() == []


@given(st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_a_match_has_its_distance_from_start_to_end(seed):
    rng = random.Random(seed)
    item = "".join(rng.choice("abcdef ") for _ in range(60)).strip() + "g"
    text = "".join(rng.choice("abcdef") for _ in range(30)) + edited(rng, item, rng.randrange(0, 4)) + "".join(rng.choice("abcdef") for _ in range(30))
    for _, distance, start, end in Matcher([(1, item)], 0.06).search(text):
        rows = list(range(len(item) + 1))
        for c in text[start:end]:
            above, rows[0] = rows[0], rows[0] + 1
            for i, p in enumerate(item, 1):
                above, rows[i] = rows[i], min(rows[i] + 1, rows[i - 1] + 1, above + (p != c))
        assert rows[-1] == distance


def test_best_match_of_an_item_counts():
    m = Matcher([(1, "abcdefghij" * 4)], 0.1)
    text = "zz" + "abcdefghij" * 3 + "abcdeXghij" + "zz" + "abcdefghij" * 4
    assert m.search(text) == [(1, 0, 44, 84)]
