"""Approximate nearest neighbours by learned partitions.

A sample's neighbour graph is cut into balanced parts by recursive spectral bisection; a small
network learns, from the vector alone, in which parts a vector's neighbours lie.  It places every
row in its most probable part and routes each query to its most probable ones; there all rows are
ranked by exact distance.

The model is fitted on at most ``sample_rows`` rows, chosen by the hash of their ids, and its size is
fixed by the dimension and the count of parts.  Every row is indexed.  A part is dealt out in tiles
of ``block_rows`` rows and ``query_rows`` queries, so a part with a third of all rows takes more
tasks, not a larger one; a vector is copied once for each tile of the other side.  A tile returns the
nearest k of its queries, merged by a window whose limit Spark also applies before the shuffle.
The count of parts grows with the rows up to a thirty-second of the sample.

Defined results: vectors that are null, empty, zero, hold null or non-finite components or have another
length than most of the sample take no part, as query or candidate; rows with the query's id are not
its candidates, and of queries with one id the first by vector counts; ties go to the smaller
vec_id; with fewer than k candidates all are returned; extra columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .neardup import _groups
from .scratch import Scratch

SAMPLE_ROWS = 8192
ROWS_PER_PART = 2048


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    k = min(k, len(x) - 1)
    norms, out = (x * x).sum(axis=1), np.empty((len(x), max(k, 0)), np.int64)
    for a in range(0, len(x), 1024):
        d = norms[None, :] - 2 * x[a : a + 1024] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        if k > 0:
            out[a : a + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, steps: int = 80, seed: int = 5) -> np.ndarray:
    """A part for each node, equal in size up to one node for each bisection.

    Each bisection orders a set by the second eigenvector of its normalised adjacency (power
    iteration) and cuts at the median, then swaps pairs of nodes whose exchange cuts fewer edges.
    """
    n, k = graph.shape
    u, v = np.repeat(np.arange(n), k), graph.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    label, random = np.zeros(n, np.int64), np.random.default_rng(seed)
    for level in range(parts.bit_length() - 1):
        inside = label[u] == label[v]
        a, b = u[inside], v[inside]
        degree = np.bincount(a, minlength=n) + 1.0
        root, vector, size = np.sqrt(degree), random.normal(size=n), 1 << level
        weight = np.maximum(np.bincount(label, degree, size), 1e-12)
        for _ in range(steps):
            flat = np.bincount(label, vector * root, size) / weight
            vector = vector - flat[label] * root
            moved = np.bincount(a, (vector / root)[b], n) / root + vector / degree
            vector = moved + vector
            vector /= np.sqrt(np.maximum(np.bincount(label, vector**2, size), 1e-300))[label]
        order = np.lexsort((vector / root, label))
        start = np.searchsorted(label[order], np.arange(size))
        count = np.bincount(label, minlength=size)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - start[label[order]]
        side = place >= (count[label] + 1) // 2
        for _ in range(6):
            gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), n)
            for part in range(size) if size <= 64 else ():
                members = np.flatnonzero(label == part)
                left, right = members[~side[members]], members[side[members]]
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                m = min(len(left), len(right))
                better = np.flatnonzero(gain[left[:m]] + gain[right[:m]] > 2)[: max(1, m // 8)]
                side[left[better]], side[right[better]] = True, False
        label = label * 2 + side
    return label


@dataclass
class Router:
    """A network of one hidden layer: probabilities of the parts for vectors."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def fit_router(x: np.ndarray, parts: int, neighbours: int = 16, hidden: int = 128, epochs: int = 30, batch: int = 256, rate: float = 3e-3, seed: int = 3) -> Router:
    """Fit to the distribution of each row's own and its neighbours' parts."""
    random = np.random.default_rng(seed)
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = float(x.std()) or 1.0 if len(x) else 1.0
    model = Router(mean, scale, random.normal(0, np.sqrt(2 / max(1, x.shape[1])), (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts))
    if len(x) < 2 or parts < 2:
        return model
    graph = neighbour_graph(x, neighbours)
    label = balanced_parts(graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), graph.shape[1] / 2)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    z = (x - mean) / scale
    params = [model.w1, model.b1, model.w2, model.b2]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order, pace = random.permutation(len(x)), rate * (1 - 0.9 * epoch / epochs)
        for a in range(0, len(x), batch):
            some = order[a : a + batch]
            h = z[some] @ params[0] + params[1]
            on = np.maximum(h, 0)
            out = on @ params[2] + params[3]
            p = np.exp(out - out.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - target[some]) / len(some)
            back = (error @ params[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((z[some].T @ back, back.sum(axis=0), on.T @ error, error.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= pace * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def calibrated_probes(x: np.ndarray, parts: int, k: int, target_recall: float, seed: int = 11) -> tuple[Router, int]:
    """A router, and how many of its parts a query must look into for ``target_recall``.

    A router fitted without a quarter of the sample is asked for that quarter's nearest k among all
    the sample; the answer holds for vectors that a router has not seen.  Where neighbours keep to
    few parts that is a few probes; where vectors have no structure it is most of them.
    """
    if len(x) < 4 * k or parts < 2:
        return fit_router(x, parts), parts
    asked = np.zeros(len(x), bool)
    asked[np.random.default_rng(seed).permutation(len(x))[: len(x) // 4]] = True
    trial = fit_router(x[~asked], parts)
    logits = trial.logits(x)
    part = logits.argmax(axis=1)
    place = np.empty_like(logits, dtype=np.int64)
    np.put_along_axis(place, np.argsort(-logits, axis=1, kind="stable"), np.arange(parts)[None, :].repeat(len(x), 0), axis=1)
    some = np.flatnonzero(asked)
    found = place[some][np.arange(len(some))[:, None], part[neighbour_graph(x, k)[some]]]
    share = np.cumsum(np.bincount(found.ravel(), minlength=parts)) / found.size
    return fit_router(x, parts), int(np.searchsorted(share, target_recall) + 1)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def nearest(embeddings: DataFrame, query: Column, scratch: Scratch, k: int = 10, parts: int | None = None, probes: int | None = None, target_recall: float = 0.96, least_candidates: int = 4096, sample_rows: int = SAMPLE_ROWS, block_rows: int = 16384, query_rows: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k nearest found for every row
    for which ``query`` (over vec_id) holds.  Each query is routed to its ``probes`` most probable
    parts (as many as the sample shows to be needed for ``target_recall``, if None), and further
    until those hold ``least_candidates`` rows."""
    sc = embeddings.sparkSession.sparkContext
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sample = rows.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id", "embedding").limit(sample_rows).select("vec_id", "embedding").toArrow()
    lists = sample.column("embedding").combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    dim = int(np.bincount(sizes).argmax()) if len(sizes) else 1
    x = np.stack([np.asarray(v.as_py()) for v in lists if len(v) == dim]) if len(lists) else np.zeros((0, 1))
    rows = rows.where(F.size("embedding") == dim)
    if parts is None:
        parts = 1 << max(3, round(np.log2(max(1, rows.count() / ROWS_PER_PART))))
    while parts > 1 and len(x) < 32 * parts:
        parts //= 2
    model, needed = calibrated_probes(x, parts, k, target_recall)
    probes = min(parts, needed if probes is None else probes)
    shared = sc.broadcast((model.mean, model.scale, model.w1, model.b1, model.w2, model.b2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            logits = Router(*shared.value).logits(_vectors(batch.column(1)))
            order = np.argsort(-logits, axis=1, kind="stable").astype(np.int32)
            asked = batch.column(2).to_numpy(zero_copy_only=False)
            ranked = [order[i] if asked[i] else None for i in range(len(order))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order[:, 0]), pa.array(ranked, pa.list_(pa.int32()))], names=["vec_id", "embedding", "part", "ranked"])

    asked = F.coalesce(query, F.lit(False))
    placed = scratch.table(rows.select("vec_id", "embedding", asked.alias("asked")).mapInArrow(place, "vec_id long, embedding array<double>, part int, ranked array<int>"), "placed")
    held = {r.part: r.n for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a part
    held_of = np.array([held.get(p, 0) for p in range(parts)])
    queries = placed.where("ranked is not null").groupBy("vec_id").agg(F.min(F.struct("embedding", "ranked")).alias("q")).select("vec_id", "q.*")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ranked = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            rows_of = held_of[ranked]
            asks = (np.arange(ranked.shape[1]) < probes) | (np.cumsum(rows_of, axis=1) - rows_of < least_candidates)
            row, place_in = np.nonzero(asks)
            for low in range(0, len(row), 4096):
                some = pa.array(row[low : low + 4096])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(ranked[row[low : low + 4096], place_in[low : low + 4096]].astype(np.int32))], names=["vec_id", "embedding", "part"])

    routed = queries.mapInArrow(route, "vec_id long, embedding array<double>, part int")
    routed = scratch.table(routed, "routed")
    asked_of = {r.part: r.n for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = F.create_map(*(F.lit(v) for p in range(parts) for v in (p, -(-held.get(p, 0) // block_rows))))
    rounds = F.create_map(*(F.lit(v) for p in range(parts) for v in (p, -(-asked_of.get(p, 0) // query_rows))))
    h = F.xxhash64("vec_id", F.lit(1))
    empty = F.array().cast("array<int>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(empty)
    c = placed.select("part", F.pmod(h, blocks[F.col("part")]).cast("int").alias("block"), F.explode(upto(rounds[F.col("part")])).alias("turn"), F.lit(1).alias("kind"), "vec_id", "embedding")
    q = routed.select("part", F.explode(upto(blocks[F.col("part")])).alias("block"), F.pmod(h, F.greatest(rounds[F.col("part")], F.lit(1))).cast("int").alias("turn"), F.lit(0).alias("kind"), "vec_id", "embedding")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3, 1):
            kind, ids, vectors = group.column(3).to_numpy(), group.column(4).to_numpy(), _vectors(group.column(5))
            members = ids[kind == 1]
            across = np.ascontiguousarray(vectors[kind == 1].T)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for one, vector in zip(ids[kind == 0], vectors[kind == 0], strict=True):
                total = np.zeros(len(members))
                for j in range(len(vector)):  # in order of components: the sum is the same everywhere
                    gap = across[j] - vector[j]
                    total += gap * gap
                total = np.sqrt(total)
                total[members == one] = np.inf
                near = np.flatnonzero(total <= np.partition(total, k - 1)[k - 1]) if len(total) > k else np.arange(len(total))
                near = near[np.isfinite(total[near])]
                near = near[np.lexsort((members[near], total[near]))][:k]
                out.append((np.full(len(near), one), members[near], total[near]))
            parts_of = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts_of], names=["query_id", "vec_id", "score"])

    work = c.unionByName(q).repartition("part", "block", "turn").sortWithinPartitions("part", "block", "turn", "kind")
    found = work.mapInArrow(rank, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
