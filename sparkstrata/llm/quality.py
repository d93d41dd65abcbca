"""Document quality by hierarchical empirical Bayes.

A classifier on the shape of the whole text (repetition, symbols, capitals, line and word lengths)
gives each document a log-odds of being good.  Grouped sums of its probabilities over all documents
give the rate of each path and site.  A path's posterior is shrunk to its site's, a site's to
the global rate, by beta priors whose strengths come from the spread of the rates between
sites (moments), so a sparse site says little.  A document's own evidence is taken out of its path's.
The posterior log-odds are the document's plus what its path adds over the global rate.

The classifier is fitted on at most ``max_train_rows`` labelled rows.  The sums are merged before
their shuffle, so a site with a third of all rows costs one row a task.

Defined results: null and empty texts have all features 0; null sites and paths are sites and paths
of their own; without labelled rows of both classes every document's evidence is 0 and all are
kept; documents sharing an id are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .scratch import Scratch
from .textwords import byte_codes, chunks, hashes, spans

MAX_TRAIN_ROWS = 20_000
KEEP_AT = 0.5


def _per_row(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flag))
    return (total[at[1:]] - total[at[:-1]]).astype(np.float64)


def features(raw: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """One row of shape features for each text."""
    rows, size = len(at) - 1, np.maximum(np.diff(at), 1)
    start, end, row = spans(raw, at)
    n = np.bincount(row, minlength=rows).astype(np.float64)
    some, word = np.maximum(n, 1), hashes(raw, start, end, codes)
    order = np.lexsort((word, row))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=rows)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    length = end - start
    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    counts = {name: _per_row(flag, at) for name, flag in (("upper", upper), ("lower", lower), ("digit", (raw >= 48) & (raw <= 57)), ("wide", raw >= 128), ("line", raw == 10), ("stop", raw == 46), ("comma", raw == 44), ("bang", (raw == 33) | (raw == 63)), ("bar", raw == 124), ("odd", np.isin(raw, np.frombuffer(b"#$%&*+/<=>@\\^_`{}~[]", np.uint8))))}
    tail = raw[end - 1] if len(end) else np.zeros(0, np.uint8)
    shouted = np.bincount(row, upper[start] & upper[np.minimum(start + 1, len(raw) - 1)], rows) if len(start) else np.zeros(rows)
    ended = np.bincount(row, (tail == 46) | (tail == 44), rows)
    symbols = np.bincount(row, ~((tail >= 128) | ((tail >= 48) & (tail <= 57)) | ((tail >= 65) & (tail <= 90)) | ((tail >= 97) & (tail <= 122)) | (tail == 46) | (tail == 44)), rows)
    columns = [
        np.log1p(n),
        distinct / some,
        distinct / np.sqrt(some),
        np.bincount(row, same, rows) / some,
        np.bincount(row, length, rows) / some,
        np.bincount(row, length == 1, rows) / some,
        np.bincount(row, length > 12, rows) / some,
        shouted / some,
        ended / some,
        symbols / some,
        counts["upper"] / np.maximum(counts["upper"] + counts["lower"], 1),
        *(np.sqrt(counts[k] / size) for k in ("digit", "wide", "line", "stop", "comma", "bang", "bar", "odd")),
    ]
    return np.stack(columns, axis=1)


N_FEATURES = 19


@dataclass
class ShapeClassifier:
    """Logistic regression on standardised features, their squares and hinges."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, z * z / 8, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)], axis=1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.expand(x) @ self.weights, -30, 30)


def fit_shape(x: np.ndarray, label: np.ndarray, ridge: float = 1.0, steps: int = 30) -> ShapeClassifier:
    """Newton steps on the log loss with a ridge; without both classes all weights are 0."""
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model = ShapeClassifier(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(1 + 4 * N_FEATURES))
    if not len(x) or label.min() == label.max():
        return model
    a = model.expand(x)
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ model.weights, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (label - p) - penalty * model.weights)
        size = np.abs(step).max()
        model.weights = model.weights + step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return model


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, max_train_rows: int = MAX_TRAIN_ROWS) -> ShapeClassifier:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(lower=False)
        for batch in batches:
            for base, raw, at in chunks(batch.column(2)):
                x = features(raw, at, codes)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, len(at) - 1), batch.column(1).slice(base, len(at) - 1), lists], names=["doc_id", "label", "x"])

    sample = labelled_sample(documents, labels, label, max_train_rows, usable).mapInArrow(run, "doc_id long, label int, x array<double>").toArrow().combine_chunks().sort_by("doc_id")
    if not sample.num_rows:
        return fit_shape(np.zeros((0, N_FEATURES)), np.zeros(0))
    x = sample.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    return fit_shape(x, sample.column("label").to_numpy().astype(np.float64))


def evidence(model: ShapeClassifier, spark: SparkSession) -> Callable[..., Column]:
    """A function of a text column: the document's own log-odds of being good."""
    shared = spark.sparkContext.broadcast((model.mean, model.scale, model.weights))

    def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classifier, codes = ShapeClassifier(*shared.value), byte_codes(lower=False)
        for texts in batches:
            out = [np.zeros(0)]
            for _, raw, at in chunks(pa.array(texts, pa.large_string())):
                out.append(classifier.margins(features(raw, at, codes)))
            yield pd.Series(np.concatenate(out))

    margin.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    # Declared so that Spark computes it once a row, not again in every expression or filter over it.
    return F.pandas_udf(margin, "double").asNondeterministic()


def _logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def _strength(groups: DataFrame, good: str, n: str, parent: Column, least: float = 1.0, most: float = 1e6) -> float:
    """The beta prior's count for rates ``good / n`` about ``parent``, by moments weighted by n:
    what the squared deviations hold beyond sampling is the spread between groups."""
    rate = F.col(good) / F.col(n)
    spread = F.sum(F.col(n) * ((rate - parent) * (rate - parent) - parent * (1 - parent) / F.col(n))) / F.sum(n)
    row = groups.agg(spread.alias("between"), (F.sum(F.col(n) * parent * (1 - parent)) / F.sum(n)).alias("within")).first()
    if row.between is None or row.between <= 0:
        return most
    return float(min(most, max(least, row.within / row.between - 1)))


def judge(documents: DataFrame, model: ShapeClassifier, scratch: Scratch, site: str = "source", path: tuple[str, ...] = ("source", "lang"), keep_at: float = KEEP_AT, columns: tuple[str, ...] | None = None) -> DataFrame:
    """row (a struct of the documents' ``columns``, all if None), evidence, site_rate, path_rate, score, keep."""
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in path))
    site_key = F.coalesce(F.col(site).cast("string"), F.lit("\x00"))
    own = evidence(model, documents.sparkSession)(F.coalesce("text", F.lit("")))
    base = documents.select(F.struct(*(columns or ["*"])).alias("row"), own.alias("evidence"), site_key.alias("site"), key.alias("path"))
    p = 1 / (1 + F.exp(-F.col("evidence")))
    base = scratch.table(base, "evidence")  # the classifier reads every text once
    paths = base.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum(p).alias("good"))
    paths = scratch.table(paths, "paths")
    sites = paths.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("good").alias("site_good"))
    total = sites.agg(F.coalesce(F.sum("site_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("site_good"), F.lit(0.0)).alias("good")).first()
    mean = (total.good + 0.5) / (total.n + 1.0)
    site_strength = _strength(sites, "site_good", "site_n", F.lit(mean))
    shrunk = sites.select("site", ((F.col("site_good") + site_strength * mean) / (F.col("site_n") + site_strength)).alias("site_rate"))
    rated = scratch.table(paths.join(shrunk, "site"), "rates")
    path_strength = _strength(rated, "good", "n", F.col("site_rate"))
    path_rate = (F.col("good") - p + path_strength * F.col("site_rate")) / (F.col("n") - 1 + path_strength)
    bounded = F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + _logit(bounded) - float(np.log(mean / (1 - mean))))))
    return base.join(rated, ["site", "path"]).select("row", "evidence", "site_rate", path_rate.alias("path_rate"), posterior.alias("score"), (posterior >= keep_at).alias("keep"))
