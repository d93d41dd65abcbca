"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a text (runs of letters, digits and bytes from 0x80
on) and their first 4 and 5 bytes, hashed to ``2**bits`` buckets.  The score is the logistic of
    w0 + sum w_i + sum over pairs i < j of <v_i, v_j>
over the buckets present, so a pair such as an insult and a group's name has a weight of its own
beside those of its parts.  Buckets that don't tell the classes apart in the sample, neither alone
(z-test) nor in a pair (z-test of all pairs of the ``PAIR_TERMS`` buckets with the most positive rows against
what their parts add up to), keep zero parameters; the others are fitted by Adam on the log loss
with weight decay.

The model is fitted on at most ``max_train_rows`` labelled rows; its size is fixed by ``bits`` and
``factors``, so broadcasting it is bounded.  Whole texts are scored where they lie, without a shuffle.

Defined results: null and empty texts have no terms and score the intercept's logistic; without
labelled rows every score is that of the prior; rows with null ids are scored too; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .textwords import byte_codes, chunks, hashes, mix, spans

BITS, FACTORS, MAX_TRAIN_ROWS = 20, 4, 12_000
#: Of so many terms of the sample all pairs are tested for an effect beside those of their parts.
PAIR_TERMS = 2048
PREFIXES = (4, 5)


def letters() -> np.ndarray:
    b = np.arange(256)
    return (b >= 128) | ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))


def terms(raw: np.ndarray, at: np.ndarray, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the distinct terms of each row, in order."""
    start, end, row = spans(raw, at, letters()[raw])
    rows, found = [row], [hashes(raw, start, end, codes)]
    for n in PREFIXES:
        long = end - start > n
        rows.append(row[long])
        found.append(hashes(raw, start[long], start[long] + n, codes) ^ np.uint64(0xA5A5A5A5 * n))
    bucket = (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)
    both = np.unique((np.concatenate(rows) << bits) | bucket)
    return both >> bits, both & ((1 << bits) - 1)


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray  # of each bucket
    factors: np.ndarray  # buckets x factors

    def margins(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        live = self.weights[bucket] != 0
        row, bucket = row[live], bucket[live]
        out = self.bias + np.bincount(row, self.weights[bucket], rows)
        v = self.factors[bucket]
        for f in range(v.shape[1]):
            out += 0.5 * (np.bincount(row, v[:, f], rows) ** 2 - np.bincount(row, v[:, f] ** 2, rows))
        return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def pair_deviations(row: np.ndarray, bucket: np.ndarray, label: np.ndarray, terms_of: np.ndarray, block: int = 2048) -> np.ndarray:
    """For each pair of the terms, how many standard deviations the positive rows among those that hold both
    are from what the two terms' own rates add up to (in log-odds)."""
    n, k = len(label), len(terms_of)
    place = np.full(int(bucket.max(initial=0)) + 1, -1)
    place[terms_of] = np.arange(k)
    col = place[bucket]
    row, col = row[col >= 0], col[col >= 0]
    both, hits = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    for low in range(0, n, block):
        here = (row >= low) & (row < low + block)
        x = np.zeros((min(block, n - low), k), np.float32)
        x[row[here] - low, col[here]] = 1
        both += x.T @ x
        positive = x[label[low : low + block] > 0]
        hits += positive.T @ positive
    prior = (label.sum() + 0.5) / (n + 1.0)
    own = (np.diag(hits) + prior) / (np.diag(both) + 1)
    extra = np.log(own / (1 - own)) - np.log(prior / (1 - prior))
    expected = logistic(np.log(prior / (1 - prior)) + extra[:, None] + extra[None, :])
    variance = both * expected * (1 - expected)
    z = (hits - both * expected) / np.sqrt(np.maximum(variance, 1e-9))
    # Too few rows for a test; or nearly all rows of one term hold the other: the pair is that term, which is tested by itself.
    count = np.diag(both)
    z[(variance < 2) | (both >= 0.95 * np.minimum(count[:, None], count[None, :]))] = 0
    return z


def unlike_rows(row: np.ndarray, bucket: np.ndarray, n: int, width: int = 8, tries: int = 4) -> np.ndarray:
    """Which rows have no earlier near copy: one that agrees in ``width`` min-hashes in one of the tries."""
    keep, some = np.ones(n, bool), np.flatnonzero(np.bincount(row, minlength=n))
    edge = np.searchsorted(row, some)
    for attempt in range(tries if len(some) else 0):
        key = np.zeros(len(some), np.uint64)
        for i in range(width):
            salt = np.uint64((1 + attempt * width + i) << 40)
            key = mix(key ^ np.minimum.reduceat(mix(bucket.astype(np.uint64) + salt), edge))
        _, first = np.unique(key, return_index=True)
        new = np.zeros(len(some), bool)
        new[first] = True
        keep[some] &= new
    return keep


def telling_terms(row: np.ndarray, bucket: np.ndarray, label: np.ndarray, size: int, min_rows: int, min_z: float, pair_z: float, pair_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that tell the classes apart by themselves, or in a pair: of the ``pair_terms`` buckets with the
    most positive rows all pairs are tested.  And which of them are told by a pair."""
    n, positive = len(label), int(label.sum())
    prior = (positive + 0.5) / (n + 1.5)
    count = np.bincount(bucket, minlength=size)
    hits = np.bincount(bucket, label[row], minlength=size)
    rate_in, rate_out = hits / np.maximum(count, 1), (positive - hits) / np.maximum(n - count, 1)
    z = (rate_in - rate_out) / np.sqrt(prior * (1 - prior) * (1 / np.maximum(count, 1) + 1 / np.maximum(n - count, 1)))
    usable = (count >= min_rows) & (count < n)
    alone = np.flatnonzero(usable & (np.abs(z) >= min_z))
    asked = np.flatnonzero(usable & (hits > 0))
    asked = np.sort(asked[np.argsort(-hits[asked], kind="stable")][:pair_terms])
    one = unlike_rows(row, bucket, n)  # copies are no evidence of a pair
    kept = one[row]
    told = np.abs(pair_deviations((np.cumsum(one) - 1)[row[kept]], bucket[kept], label[one], asked)).max(axis=1, initial=0) >= pair_z if len(asked) else np.zeros(0, bool)
    chosen = np.union1d(alone, asked[told])
    return chosen, np.isin(chosen, asked[told])


def fit_machine(row: np.ndarray, bucket: np.ndarray, label: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = 100, rate: float = 0.05, decay: float = 0.3, pair_decay: float = 1.0, min_rows: int = 3, min_z: float = 4.0, pair_z: float = 10.0, pair_terms: int = PAIR_TERMS, seed: int = 7) -> FactorizationMachine:
    """Fit on the terms (row, bucket) of labelled rows."""
    n, size = len(label), 1 << bits
    positive = int(label.sum())
    prior = (positive + 0.5) / (n + 1.5)
    machine = FactorizationMachine(float(np.log(prior / (1 - prior))), np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    if not positive or positive == n:
        return machine
    chosen, paired = telling_terms(row, bucket, label, size, min_rows, min_z, pair_z, pair_terms)
    if not len(chosen):
        return machine
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[bucket] >= 0
    row, col = row[keep], place[bucket[keep]]
    random = np.random.default_rng(seed)
    params = [np.array([machine.bias]), np.zeros(len(chosen)), random.normal(0, 1, (len(chosen), factors)) * np.where(paired, 0.1, 0.02)[:, None]]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        bias, w, v = params
        each = v[col]
        sums = np.stack([np.bincount(row, each[:, f], n) for f in range(factors)], axis=1)
        squares = np.stack([np.bincount(row, each[:, f] ** 2, n) for f in range(factors)], axis=1)
        margin = bias[0] + np.bincount(row, w[col], n) + 0.5 * (sums**2 - squares).sum(axis=1)
        error = (logistic(margin) - label) / n
        at_term = error[row]
        pull = at_term[:, None] * (sums[row] - each)
        grads = [np.array([error.sum()]), np.bincount(col, at_term, len(chosen)) + decay / n * w, np.stack([np.bincount(col, pull[:, f], len(chosen)) for f in range(factors)], axis=1) + pair_decay / n * v]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    machine.bias = float(params[0][0])
    machine.weights[chosen] = params[1]
    machine.factors[chosen] = params[2]
    return machine


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None, max_train_rows: int = MAX_TRAIN_ROWS, bits: int = BITS, factors: int = FACTORS) -> FactorizationMachine:
    """Fit on the driver; terms are taken on the executors, and at most ``max_train_rows`` rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(lower=True)
        for batch in batches:
            for base, raw, at in chunks(batch.column(2)):
                rows = len(at) - 1
                row, bucket = terms(raw, at, codes, bits)
                edge = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, rows), batch.column(1).slice(base, rows), lists], names=["doc_id", "label", "terms"])

    sample = labelled_sample(documents, labels, label, max_train_rows, usable).mapInArrow(run, "doc_id long, label int, terms array<int>").toArrow().combine_chunks().sort_by("doc_id")
    lists = sample.column("terms").combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.int32()))
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return fit_machine(row, lists.flatten().to_numpy().astype(np.int64), sample.column("label").to_numpy().astype(np.float64), bits, factors)


def score(documents: DataFrame, machine: FactorizationMachine, bits: int = BITS) -> DataFrame:
    """doc_id, score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))  # plain arrays: workers need no class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes = FactorizationMachine(*shared.value), byte_codes(lower=True)
        for batch in batches:
            out = [np.zeros(0)]
            for _, raw, at in chunks(batch.column(1)):
                row, bucket = terms(raw, at, codes, bits)
                out.append(logistic(model.margins(row, bucket, len(at) - 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
