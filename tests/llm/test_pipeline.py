import random

import corpus_pipeline
from corpus_pipeline import STAGES, run
from sparkstrata.llm import quality
from sparkstrata.llm.scratch import Scratch

from .test_neardup import brute
from .test_quality import bad, good
from .test_substrings import kept_words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    rng = random.Random(9)
    passage = " ".join(f"shared{i}" for i in range(70))
    item = " ".join(f"question{i}" for i in range(20))
    texts = [good(rng) + f" Mark{i} " + good(rng) for i in range(160)] + [bad(rng) for _ in range(40)]
    texts += [texts[3], texts[4] + " Extra.", texts[5] * 6, texts[5] * 6 + " More."]
    texts += [good(rng) * 2 + " " + passage + " " + good(rng) * 2 for _ in range(3)]
    texts += [good(rng) + " " + item.upper() + " " + good(rng), good(rng) + " " + item + ". " + good(rng)]
    texts += ["", None]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 160), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, item, passage


def test_stages_agree_with_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows, item, passage = tables(spark, folder)
    docs, names = spark.read.parquet(f"{folder}/documents.parquet"), [n for n, _ in STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "mixing sources to target weights"]
    seen = [docs]
    for name, stage in STAGES:
        out = stage(spark, seen[-1], folder)
        path = f"{folder}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        seen.append(spark.read.parquet(path))
    kept = [{r.doc_id: r.text for r in d.collect()} for d in seen[:-1]]
    assert all(d.columns == docs.columns for d in seen[:-1])
    # 1: what the operator keeps; bad documents go, good ones stay.
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    judged = {r.row.doc_id for r in quality.judge(docs, model, Scratch(spark, "t")).where("keep").collect()}
    assert set(kept[1]) == judged and not judged & set(range(160, 200)) and len(judged & set(range(160))) >= 158
    # 2: one of each group.
    groups = brute(sorted(kept[1].items()), 5)
    assert set(kept[2]) == {i for i, (_, c) in groups.items() if i == c}
    # 3: repeated passages of 50 words and more go.
    want = {i: w for i, w, _ in kept_words(sorted(kept[2].items()), 50)}
    assert {i: (t or "").split() for i, t in kept[3].items()} == want
    assert sum(passage in (t or "") for t in kept[3].values()) == 1
    # 4: documents with the item go.
    assert set(kept[4]) == {i for i, t in kept[3].items() if item not in (t or "").lower()}
    # 5: budgets of documents that were kept.
    mixed = seen[5].collect()
    assert mixed and {r.doc_id for r in mixed} <= set(kept[4]) and set(docs.columns) < set(seen[5].columns)


def test_near_duplicates_go_by_row_not_by_id(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(40)) for x in "abcd")
    rows = [(1, a), (5, a), (2, b), (5, b), (7, b), (7, c), (8, d), (8, d), (9, d + " end"), (None, a), (4, ""), (4, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "t") for i, t in rows], DOCUMENTS + ", text_key string")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == sorted([(1, a), (2, b), (7, c), (8, d), (0, a), (4, ""), (4, ""), (6, "")])


def test_run_gives_the_last_stage(spark, tmp_path):
    tables(spark, str(tmp_path))
    got = run(spark, str(tmp_path)).collect()
    assert got and "mix_epoch" in got[0].asDict()


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCUMENTS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert run(spark, str(tmp_path)).collect() == [] and corpus_pipeline.ORACLE_SQL is None
