import random

import numpy as np

from sparkstrata.llm.toxicity import FactorizationMachine, fit_machine, logistic, score, terms, train, unlike_rows
from sparkstrata.llm.labelled import labelled_sample
from sparkstrata.llm.textwords import byte_codes, chunks
import pyarrow as pa

SCHEMA = "doc_id long, text string, score double, label int, toxic int"


def taken(texts, bits=16):
    rows, buckets = [], []
    for base, raw, at in chunks(pa.array(texts)):
        r, b = terms(raw, at, byte_codes(True), bits)
        rows.append(r + base)
        buckets.append(b)
    return np.concatenate(rows), np.concatenate(buckets)


def test_terms_fold_case_and_punctuation():
    _, a = taken(["Scum!"])
    _, b = taken(["  scum"])
    assert a.tolist() == b.tolist() and len(a) == 1


def test_margin_is_that_of_all_pairs():
    rng = np.random.default_rng(0)
    m = FactorizationMachine(0.3, rng.normal(size=32).astype(np.float32), rng.normal(size=(32, 3)).astype(np.float32))
    row, bucket = np.array([0, 0, 0, 2, 2]), np.array([1, 5, 9, 5, 30])
    want = []
    for r in range(3):
        x = bucket[row == r]
        want.append(0.3 + sum(m.weights[i] for i in x) + sum(float(m.factors[i] @ m.factors[j]) for k, i in enumerate(x) for j in x[k + 1 :]))
    assert np.allclose(m.margins(row, bucket, 3), want)


def test_interactions_are_learned():
    """Neither word is toxic by itself, the pair is: an additive model can't tell the four cases apart."""
    rng = random.Random(3)
    texts, labels = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join((["insult"] if a else []) + (["group"] if b else []) + [f"n{rng.randrange(200)}" for _ in range(6)]))
        labels.append(float(a == b))
    row, bucket = taken(texts)
    m = fit_machine(row, bucket, np.array(labels), bits=16)  # with the query's own parameters
    predicted = logistic(m.margins(row, bucket, len(texts))) >= 0.5
    assert (predicted == (np.array(labels) == 1)).mean() > 0.97
    additive = FactorizationMachine(m.bias, m.weights, 0 * m.factors)
    assert ((logistic(additive.margins(row, bucket, len(texts))) >= 0.5) == (np.array(labels) == 1)).mean() < 0.8


def test_an_insult_with_a_group_mention_is_learned():
    """Each is common in clean texts; together they are toxic."""
    rng = random.Random(4)

    def some(n):
        texts, labels = [], []
        for _ in range(n):
            a, b = rng.random() < 0.15, rng.random() < 0.15
            texts.append(" ".join([f"n{rng.randrange(500)}" for _ in range(20)] + (["insult"] if a else []) + (["group"] if b else [])))
            labels.append(float(a and b))
        return texts, np.array(labels)

    texts, labels = some(4000)
    m = fit_machine(*taken(texts), labels, bits=16)
    texts, labels = some(2000)
    assert ((logistic(m.margins(*taken(texts), len(texts))) >= 0.5) == (labels == 1)).mean() > 0.99


def test_near_copies_count_once():
    rows = [f"w{i} x{i} y{i} z{i} v{i}" for i in range(50)] + ["same old text again and again"] * 40
    row, bucket = taken(rows)
    kept = unlike_rows(row, bucket, len(rows))
    assert kept[:50].all() and kept[50:].sum() == 1


def corpus(n=900):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        toxic = i % 8 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["vermin", "Scum,", "loweiabc", "loweixyz"])
        rows.append((i, " ".join(text), 0.0, 1, int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    m = train(df, df.select("doc_id", "toxic"), usable=df.doc_id % 5 != 0)
    got = {r.doc_id: r.score for r in score(df, m).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert len(got) == len(rows) and np.mean([(got[r[0]] >= 0.5) == (r[4] == 1) for r in held]) > 0.97


def test_a_hot_id_is_one_row_of_the_sample(spark):
    rows = corpus(100) + [(0, f"word{i} vermin", 0.0, 1, 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    sample = labelled_sample(df, df.select("doc_id", "toxic"), "toxic", 50).collect()
    assert len(sample) == 50 and len({r.doc_id for r in sample}) == 50


def test_edge_cases(spark):
    rows = [*corpus(200), (None, "scum", 0.0, 1, None), (901, None, 0.0, 1, None), (902, "", 0.0, 1, 1), (902, "", 0.0, 1, 0), (903, "vermin " + "x" * 300_000, 0.0, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = df.select("doc_id", "toxic")
    m = train(df, labels, max_train_rows=150)
    got = score(df, m).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    bare = train(df, labels.limit(0))
    assert {r.score < 0.5 for r in score(df, bare).collect()} == {True}
    assert score(df.limit(0), bare).collect() == []
