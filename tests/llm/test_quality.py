import math
import random

import numpy as np
import pyarrow as pa

from sparkstrata.llm.quality import features, fit_shape, judge, train, N_FEATURES
from sparkstrata.llm.scratch import Scratch
from sparkstrata.llm.textwords import byte_codes, chunks

SCHEMA = "doc_id long, text string, source string, lang string, quality int, site string, keep string, n long"


def good(rng):
    return ". ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(4, 14))).capitalize() for _ in range(rng.randrange(2, 12))) + "."


def bad(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join([rng.choice(WORDS)] * rng.randrange(20, 60))
    if kind == 1:
        return " ".join(rng.choice(WORDS) + rng.choice(["***", "$$$"]) for _ in range(40))
    return " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(40))


WORDS = ["".join(random.Random(i).choice("aeioustrnlm") for _ in range(2 + i % 7)) for i in range(300)]


def table(n=600, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        q = int(rng.random() < 0.8)
        rows.append((i, good(rng) if q else bad(rng), "hot" if i % 3 else f"s{i % 30}", rng.choice(["en", "de", None]), q, "x", "y", 1))
    return rows


def test_features_fit_any_text():
    texts = ["", " ", "a", "A!! B!!", "é é é\n\nx | y | z", "w" * 100_000, "Plain text. With, commas."]
    (base, raw, at), *_ = chunks(pa.array(texts))
    x = features(raw, at, byte_codes(False))
    assert x.shape == (7, N_FEATURES) and np.isfinite(x).all() and (x[0] == 0).all()


def test_held_out_accuracy_and_all_columns(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    m = train(df, df.select("doc_id", "quality"), usable=df.doc_id % 5 != 0)
    got = judge(df, m, Scratch(spark, "t")).collect()
    assert len(got) == len(rows) and list(got[0].row.asDict()) == df.columns
    held = [r for r in got if r.row.doc_id % 5 == 0]
    assert np.mean([r.keep == (r.row.quality == 1) for r in held]) > 0.97


def test_posteriors_follow_the_formula(spark):
    rows = table(300)
    df = spark.createDataFrame(rows, SCHEMA)
    m = train(df, df.select("doc_id", "quality"))
    got = judge(df, m, Scratch(spark, "t"), columns=("doc_id", "source", "lang")).collect()
    p = {r.row.doc_id: 1 / (1 + math.exp(-r.evidence)) for r in got}
    sums = {}
    for r in got:
        for key in (r.row.source, (r.row.source, r.row.lang)):
            n, s = sums.get(key, (0, 0.0))
            sums[key] = n + 1, s + p[r.row.doc_id]
    mean = (sum(p.values()) + 0.5) / (len(p) + 1)
    by_site = {}
    for r in got:
        n, s = sums[r.row.source]
        by_site.setdefault(r.row.source, r.site_rate)
        # The site's rate lies between its own mean and the global one.
        assert min(s / n, mean) - 1e-9 <= r.site_rate <= max(s / n, mean) + 1e-9
        n, s = sums[r.row.source, r.row.lang]
        own = (s - p[r.row.doc_id]) / (n - 1) if n > 1 else r.site_rate
        assert min(own, r.site_rate) - 1e-9 <= r.path_rate <= max(own, r.site_rate) + 1e-9
        rate = min(max(r.path_rate, 1e-6), 1 - 1e-6)
        want = r.evidence + math.log(rate / (1 - rate)) - math.log(mean / (1 - mean))
        assert math.isclose(r.score, 1 / (1 + math.exp(-want)), abs_tol=1e-9) and r.keep == (r.score >= 0.5)
    big = abs(by_site["hot"] - sums["hot"][1] / sums["hot"][0])
    assert big <= max(abs(by_site[k] - sums[k][1] / sums[k][0]) for k in by_site)


def test_edge_cases(spark):
    rows = [*table(100), (None, None, None, None, None, None, None, None), (1, "", "s1", "en", 0, "x", "y", 1), (1, "", "s1", "en", 0, "x", "y", 1), (7, "long " * 60_000, "s", "en", None, "x", "y", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = judge(df, train(df, df.select("doc_id", "quality")), Scratch(spark, "t")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = train(df, df.select("doc_id", "quality").limit(0))
    assert all(r.keep and r.evidence == 0 for r in judge(df, none, Scratch(spark, "t")).collect())
    assert judge(df.limit(0), none, Scratch(spark, "t")).collect() == []


def test_one_class_gives_no_evidence():
    assert (fit_shape(np.ones((5, N_FEATURES)), np.ones(5)).weights == 0).all()
