import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkstrata.llm.ann import balanced_parts, nearest, neighbour_graph
from sparkstrata.llm.scratch import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, part int, score double"


def brute(ids, x, asked, k):
    out = {}
    for i in asked:
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += (x[:, j] - x[i, j]) ** 2
        d = np.sqrt(d)
        order = [o for o in np.lexsort((ids, d)) if ids[o] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[o]), d[o]) for o in order]
    return out


def clustered(n, dim=16, seed=0, groups=40):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)


def frame(spark, x, start=0):
    return spark.createDataFrame([(i + start, v.tolist(), 1, 2, 3.0) for i, v in enumerate(x)], SCHEMA)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_against_brute_force(spark):
    x = clustered(4000)
    got = found(nearest(frame(spark, x), F.col("vec_id") % 20 == 0, Scratch(spark, "t"), parts=16, least_candidates=10, sample_rows=2000, block_rows=500, query_rows=16))
    want = brute(np.arange(4000), x.astype(float), range(0, 4000, 20), 10)
    assert got.keys() == want.keys()
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    exact = np.linalg.norm(x[0].astype(float) - x[got[0][0][0]].astype(float))
    assert got[0][0][1] == pytest.approx(exact, abs=1e-12)


def test_recall_on_vectors_without_structure(spark):
    """The defaults' calibration, with too few candidates to make the search exhaustive by themselves."""
    x = np.random.default_rng(1).normal(size=(6000, 16)).astype(np.float32)
    got = found(nearest(frame(spark, x), F.col("vec_id") % 50 == 0, Scratch(spark, "t"), least_candidates=100))
    want = brute(np.arange(6000), x.astype(float), range(0, 6000, 50), 10)
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) / (10 * len(want)) >= 0.9


def test_small_tables_are_searched_whole(spark):
    x = np.round(clustered(300, dim=4), 1)  # many ties
    x[:40] = x[0]
    got = found(nearest(frame(spark, x), F.col("vec_id") % 10 == 0, Scratch(spark, "t")))
    assert got == brute(np.arange(300), x.astype(float), range(0, 300, 10), 10)


def test_parts_are_balanced_and_cut_few_edges():
    x = clustered(1024).astype(float)
    graph = neighbour_graph(x, 8)
    label = balanced_parts(graph, 8)
    assert np.bincount(label, minlength=8).tolist() == [128] * 8
    assert (label[graph] == label[:, None]).mean() > 2 * (1 / 8)


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [5.0, 0.0]), (9, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 1, 1.0) for i, v in rows], SCHEMA)
    got = found(nearest(df, F.col("vec_id").isin(0, 4), Scratch(spark, "t")))
    assert got == {0: [(1, 0.0), (9, 1.0)]}
    assert nearest(df.limit(0), F.col("vec_id") == 0, Scratch(spark, "t")).collect() == []
    assert nearest(df, F.col("vec_id") == 77, Scratch(spark, "t")).collect() == []
