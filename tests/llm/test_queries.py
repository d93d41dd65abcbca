"""The registered queries themselves, on small tables with hard rows: against their SQL where there is any,
against brute force where there is none."""

import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sparkstrata.llm import quality, toxicity
from sparkstrata.llm.decontaminate import normalise
from sparkstrata.llm.oracles import ORACLES
from sparkstrata.llm.queries import QUERIES
from sparkstrata.llm.textwords import byte_codes, chunks

from .test_chat import HARD
from .test_decontaminate import edited, slow_distance
from .test_quality import bad, good
from .test_urlrules import URLS

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string, host string",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string, n_turns long",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("tables"), random.Random(2)
    items = [(i, " ".join(f"q{rng.randrange(40)}z" for _ in range(18))) for i in range(5)] + [(5, None), (6, " ")]
    texts = [good(rng) if i % 4 else bad(rng) for i in range(150)]
    texts = [t + (" Vermin scum." if i % 5 == 1 else "") for i, t in enumerate(texts)]
    texts += [texts[3], texts[7] + " Tail.", texts[8] * 3, "", None, " \n", "One two", "one TWO", "x" * 200_000, "word " * 30_000]
    texts += [good(rng) + " " + edited(rng, items[i % 5][1], i % 8).upper() + " " + good(rng) for i in range(15)]
    rows = [(i, t, rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 7}", len(t or ""), 0.5, True) for i, t in enumerate(texts)]
    data = {
        "documents": rows,
        "labels": [(i, int(i % 4 > 0), int(i % 5 == 1)) for i in range(150)] + [(3, 0, None), (None, 1, 1), (10_000, 1, 1)],
        "pages": [(i, u, f"<p>{i % 6}</p>" if i % 5 else None, "h") for i, u in enumerate(URLS + [f"http://h{i % 3}.com/a/{i}/b/c/d{i % 4}" for i in range(60)])],
        "benchmark": items,
        "conversations": [(c, t, ["user", "assistant", "a:b\\"][(c + t) % 3], HARD[(c + t) % len(HARD)], 1) for c in range(9) for t in range(c)] + [(9, 0, None, None, 1), (9, 1, "assistant", None, 1)],
        "embeddings": [(i, [rng.gauss(0, 1) for _ in range(8)], 1) for i in range(300)] + [(400, None, 1), (500, [0.0] * 8, 1), (600, [float("nan")] * 8, 1)],
    }
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(data[name], schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), data


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    db = duckdb.connect()
    for table in SCHEMAS:
        db.execute(f"create view {table} as select * from read_parquet('{tables[0]}/{table}.parquet/*.parquet')")
    got, want = QUERIES[name](spark, tables[0]), db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_op3_scores_are_the_machines(spark, tables):
    """The machine is fitted anew from its terms, and each score summed pair by pair."""
    documents = {r[0]: r[1] or "" for r in tables[1]["documents"]}
    label = {}
    for i, _, toxic in tables[1]["labels"]:
        if i in documents and toxic is not None and zlib.crc32(str(i).encode()) % 5:
            label[i] = max(toxic, label.get(i, 0))

    def terms(text):
        out = [toxicity.terms(raw, at, byte_codes(True), toxicity.BITS)[1] for _, raw, at in chunks(pa.array([text]))]
        return out[0].tolist() if out else []

    ids = sorted(label)
    each = [terms(documents[i]) for i in ids]
    row = np.repeat(np.arange(len(ids)), [len(t) for t in each])
    m = toxicity.fit_machine(row, np.array(sum(each, []), np.int64), np.array([float(label[i]) for i in ids]))
    got = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, tables[0]).collect()}
    assert got.keys() == documents.keys()
    for i, r in got.items():
        x = terms(documents[i])
        margin = m.bias + sum(float(m.weights[t]) for t in x)
        live = [t for t in x if m.weights[t]]
        margin += sum(float(m.factors[a] @ m.factors[b]) for k, a in enumerate(live) for b in live[k + 1 :])
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-60, min(60, margin)))), abs_tol=1e-4)
    held = [i for i in range(150) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 5 == 1) for i in held) >= len(held) - 1


def test_op5_finds_what_brute_force_finds(spark, tables):
    want = {}
    for d, text, *_ in tables[1]["documents"]:
        body = normalise(text)
        for i, item in tables[1]["benchmark"]:
            x = normalise(item)
            if x and len(body) < 20_000 and (distance := slow_distance(x, body)) <= int(0.05 * len(x)):
                want[d, i] = distance
    assert len(want) >= 6
    assert {(r.doc_id, r.item_id): r.distance for r in QUERIES["op5_decontaminate"](spark, tables[0]).collect()} == want


def test_op9_is_the_formula(spark, tables):
    rows = QUERIES["op9_quality"](spark, tables[0]).collect()
    lang = {r[0]: (r[3], r[2]) for r in tables[1]["documents"]}
    assert len(rows) == len(lang)
    p = {r.doc_id: 1 / (1 + math.exp(-r.evidence)) for r in rows}

    def sums(key):
        out = {}
        for i, v in p.items():
            n, s = out.get(key(i), (0, 0.0))
            out[key(i)] = n + 1, s + v
        return out

    def strength(groups, parent):
        total = sum(n for n, _ in groups.values())
        between = sum(n * ((s / n - parent(k)) ** 2 - parent(k) * (1 - parent(k)) / n) for k, (n, s) in groups.items()) / total
        within = sum(n * parent(k) * (1 - parent(k)) for k, (n, _) in groups.items()) / total
        return 1e6 if between <= 0 else min(1e6, max(1.0, within / between - 1))

    mean = (sum(p.values()) + 0.5) / (len(p) + 1)
    sites, paths = sums(lambda i: lang[i][0]), sums(lambda i: lang[i])
    a = strength(sites, lambda _: mean)
    site_rate = {k: (s + a * mean) / (n + a) for k, (n, s) in sites.items()}
    b = strength(paths, lambda k: site_rate[k[0]])
    for r in rows:
        n, s = paths[lang[r.doc_id]]
        path = (s - p[r.doc_id] + b * site_rate[r.source]) / (n - 1 + b)
        assert math.isclose(r.site_rate, site_rate[r.source], rel_tol=1e-9) and math.isclose(r.path_rate, path, rel_tol=1e-9)
        held = min(max(path, 1e-6), 1 - 1e-6)
        score = 1 / (1 + math.exp(-(r.evidence + math.log(held / (1 - held)) - math.log(mean / (1 - mean)))))
        assert math.isclose(r.score, score, abs_tol=1e-9) and r.keep == (score >= quality.KEEP_AT)
    assert sum(r.keep == (r.doc_id % 4 > 0) for r in rows if r.doc_id < 150) >= 145
