import hashlib
import random
import re

import numpy as np
import pytest

from sparkstrata.llm import substrings
from sparkstrata.llm.fmindex import FMIndex, WaveletMatrix
from sparkstrata.llm.substrings import remove_repeats, removal_digests

SCHEMA = "doc_id long, text string, spans string, words int, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept_words(docs, n=13):
    first = {}
    for i, t in docs:
        w = words_of(t)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((i, [x for x, g in zip(w, gone, strict=True) if not g], len(w)))
    return out


def corpus(seed, n_docs=120):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [say(k) for k in (13, 14, 20, 55, 12, 90)]
    docs = []
    for i in range(n_docs):
        parts = [say(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), say(rng.randrange(0, 25))]
        if i % 9 == 0 and docs:
            parts = [docs[rng.randrange(len(docs))][1].split()]
        docs.append((i, rng.choice([" ", "\n", "  ", "\t"]).join(sum(parts, []))))
    docs.append((n_docs, "same " * 300))
    docs.append((n_docs + 1, "same " * 200 + "end"))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "hot", "shard"), [(1, 4096, 1 << 17), (2, 2, 500), (3, 1, 60), (4, 10, 1)])
def test_digests_equal_brute_force(spark, seed, hot, shard):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in docs], SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in removal_digests(df, hot_rows=hot, shard_words=shard).collect()}
    want = {i: (n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, k, n in kept_words(docs)}
    assert got == want


def thue_morse(n, one="a", other="b"):
    return "".join(one if bin(i).count("1") % 2 == 0 else other for i in range(n))


def test_words_that_polynomials_confuse_are_told_apart(spark):
    docs = [(k, " ".join([word] + [f"c{i}" for i in range(12)])) for k, word in enumerate([thue_morse(2048), thue_morse(2048, "b", "a"), "x" * 40, "x" * 39 + "y", thue_morse(2048)])]
    df = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in docs], SCHEMA)
    got = {r.doc_id: r.n_removed for r in removal_digests(df).collect()}
    assert got == {i: n - len(k) for i, k, n in kept_words(docs)} and got[1] == 0 and got[4] == 13


def test_removal_keeps_clean_texts_to_the_byte(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f" lead  {passage}\ttail ", "a", 1, 7), (2, f"other {passage}\n last  words", "b", 1, 7), (3, " clean \n text ", "c", 1, 7), (4, None, None, None, None), (5, passage, "d", 1, 7)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, SCHEMA), window=50).collect()}
    assert list(got[1].asDict()) == ["doc_id", "text", "spans", "words", "n_chars"]
    assert (got[1].text, got[1].n_chars, got[3].text, got[3].n_chars) == (rows[0][1], 7, " clean \n text ", 7)
    assert (got[2].text, got[2].n_chars, got[2].spans) == ("other last  words", 17, "b")
    assert (got[4].text, got[5].text, got[5].n_chars) == (None, "", 0)


def test_edge_cases(spark):
    run = " ".join(f"r{i}" for i in range(20))
    rows = [(None, run, "", 1, 0), (1, run, "", 1, 0), (1, run, "", 1, 0), (2, run, "", 1, 0), (3, None, "", 1, 0), (4, "", "", 1, 0), (5, " ".join(f"q{i % 89}" for i in range(50_000)), "", 1, 0)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in removal_digests(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 20, 0), (1, 20, 0), (1, 20, 0), (2, 20, 20), (3, 0, 0), (4, 0, 0), (5, 50_000, 0)]
    assert removal_digests(spark.createDataFrame([], SCHEMA)).collect() == []
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_wavelet_rank():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 37, 1000)
    w = WaveletMatrix(s, 37)
    c, at = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert w.rank(c.astype(np.uint32), at).tolist() == [int((s[:p] == x).sum()) for x, p in zip(c, at, strict=True)]


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(1)
    segments = [rng.integers(0, 3, rng.integers(1, 30)) for _ in range(40)]
    index = FMIndex(np.concatenate(segments), np.append(0, np.cumsum([len(x) for x in segments])), 5)
    sizes = [len(x) for x in segments]
    place = np.concatenate([np.arange(n) for n in sizes])
    last = index.at[place >= 4]
    low, high, length = index.matching_statistics(last)
    text = index.text.tolist()
    for e, a, b, n in zip(last, low, high, length, strict=True):
        pattern = text[e - n + 1 : e + 1]
        assert b - a == sum(text[i : i + n] == pattern for i in range(len(text)))


def test_an_anchor_of_long_segments_is_cut_into_windows(spark, tmp_path, monkeypatch):
    """Few documents that repeat one line over and over: no shard holds all their words."""
    line = " ".join(f"line{i}" for i in range(20))
    docs = [(i, f"head{i} " * 30 + f"{line} " * (490 + i)) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain, sizes = substrings._indexed, str(tmp_path / "sizes")

    def watched(words, ids, window):
        with open(sizes, "a") as f:
            f.write(f"{sum(len(w.split()) for w in words.to_pylist())}\n")
        return plain(words, ids, window)

    monkeypatch.setattr(substrings, "_indexed", watched)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in removal_digests(df, window=50).collect()}
    assert got == {i: (n, n - len(k)) for i, k, n in kept_words(docs, 50)}
    with open(sizes) as f:
        assert 0 < max(map(int, f)) < 30_000  # of 303,000 words


@pytest.mark.parametrize(("window", "piece"), [(13, 1), (13, 7), (50, 256)])
def test_a_hot_group_sends_pieces_not_windows(spark, tmp_path, monkeypatch, window, piece):
    """Documents that share lines over and over, with words of their own here and there."""
    rng = random.Random(5)
    line = [f"line{i}" for i in range(20)]
    docs = []
    for i in range(40):
        words = [f"head{i}"] * 15 + line * (100 + i)
        for _ in range(3):
            words[rng.randrange(15, len(words))] = f"own{rng.randrange(40)}"
        docs.append((i, " ".join(words)))
    rng.shuffle(docs)
    made, plain = str(tmp_path / "made"), {name: getattr(substrings, name) for name in ("_cut", "_windows") if hasattr(substrings, name)}

    def watched(name):
        def outer(*args):
            run = plain[name](*args)

            def counted(batches):
                for batch in run(batches):
                    with open(made, "a") as f:
                        f.write(f"{batch.num_rows}\n")
                    yield batch

            return counted

        return outer

    for name in plain:
        monkeypatch.setattr(substrings, name, watched(name))
    parameters = {"hot_windows": 1000, "window": window} | ({"piece": piece} if hasattr(substrings, "_windows") else {})
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in removal_digests(spark.createDataFrame(docs, "doc_id long, text string"), **parameters).collect()}
    assert got == {i: (n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, k, n in kept_words(docs, window)}
    if window == 50:
        with open(made) as f:
            total = sum(map(int, f))
        assert 0 < total < 20_000  # a row for each of the windows made 97,981
