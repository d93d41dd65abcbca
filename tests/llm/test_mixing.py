import math
import random
import re

import pytest

from sparkstrata.llm import mixing
from sparkstrata.llm.mixing import mix, realise, solve
from sparkstrata.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, source string, weight double, copies int, block int"


def table(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = None if rng.random() < 0.03 else "big" if rng.random() < 0.6 else f"s{rng.randrange(6)}"
        out.append((i, rng.choice([" ", "\n", "\t "]).join(["w"] * rng.randrange(0, 30)), source, 0.5, 1, 2))
    return out


def tokens(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_budgets_are_filled(spark):
    rows = table()
    got = mix(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"), min_entropy=0.99, max_repeats=None, blocks=8).collect()
    assert len(got) == len(rows)
    total = sum(tokens(t) for _, t, *_ in rows)
    for source in {r[2] for r in rows}:
        mine = [r for r in got if r.source == source]
        budget = math.floor(mine[0].weight * total + 1e-6)
        spent = sum(r.n_tokens * r.copies for r in mine)
        assert budget - 30 < spent <= budget
        assert len({r.epochs for r in mine if r.n_tokens}) == 1 and all(r.copies == 0 for r in mine if not r.n_tokens)
    weights = {r.source: r.weight for r in got if r.n_tokens}
    entropy = -sum(w * math.log(w) for w in weights.values())
    assert math.isclose(sum(weights.values()), 1, abs_tol=1e-9) and math.isclose(entropy, 0.99 * math.log(len(weights)), abs_tol=1e-6)


def test_local_and_distributed_bisection_agree(spark, monkeypatch):
    totals = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100), ("d", 0), (None, 50)], "source string, tokens long")
    near = solve(totals, 0.8, 4.0, 1.0)
    monkeypatch.setattr(mixing, "LOCAL_SOURCES", 0)
    monkeypatch.setattr(mixing, "STEPS", 20)
    far = solve(totals, 0.8, 4.0, 1.0)
    assert math.isclose(near.exponent, far.exponent, abs_tol=1e-5) and near.total_tokens == 1160


@pytest.mark.parametrize(("entropy", "repeats"), [(1.0, None), (0.5, None), (1.0, 2.0), (1.0, 0.5)])
def test_targets(spark, entropy, repeats):
    totals = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100)], "source string, tokens long")
    w = solve(totals, entropy, repeats, 1.0)
    q = [1000 / 1110, 10 / 1110, 100 / 1110]
    p = [x**w.exponent / w.norm for x in q]
    most = max(a / b for a, b in zip(p, q, strict=True))
    if repeats is None:
        assert -sum(x * math.log(x) for x in p) >= entropy * math.log(3) - 1e-9 or entropy == 1.0
        assert w.exponent < 1e-9 if entropy == 1.0 else w.exponent > 0
    elif repeats >= 1:
        assert math.isclose(most, repeats, rel_tol=1e-6)
    else:
        assert w.exponent == 1.0


def test_realised_rows(spark):
    rows = table(2)
    df = spark.createDataFrame(rows, SCHEMA)
    drawn = mix(df, Scratch(spark, "t"), min_entropy=1.0, blocks=4).cache()
    copies = {r.doc_id: r.copies for r in drawn.collect()}
    got = realise(df, drawn, blocks=4).collect()
    assert len(got) == sum(copies.values()) and max(copies.values()) > 1
    assert all(list(r.row.asDict()) == df.columns and 0 <= r.epoch < copies[r.row.doc_id] for r in got)
    first = {r.row.doc_id: r.position for r in got if r.epoch == 0}
    second = {r.row.doc_id: r.position for r in got if r.epoch == 1}
    again = sorted(second, key=second.get)
    assert sorted(second, key=first.get) != again


def test_edge_cases(spark):
    rows = [(None, "a b", "s", 0.0, 1, 1), (1, None, "s", 0.0, 1, 1), (2, "", "t", 0.0, 1, 1), (3, "a", "t", 0.0, 1, 1), (3, "a b", "t", 0.0, 1, 1), (4, "w " * 100_000, None, 0.0, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix(df, Scratch(spark, "t")).collect()
    assert len(got) == 6 and {r.n_tokens for r in got} == {0, 1, 2, 100_000}
    assert all(r.copies == 0 for r in got if r.doc_id in (None, 1, 2))
    assert mix(df.limit(0), Scratch(spark, "t")).collect() == []
    assert mix(df.where("doc_id = 2"), Scratch(spark, "t")).first().copies == 0
