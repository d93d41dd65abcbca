"""Mixing sources to target weights by temperature.

A source's share q of all tokens becomes the weight q**t / sum(q**t).  The exponent t in [0, 1] is
bisected: the largest t whose weights have at least ``min_entropy`` of the greatest possible
entropy, then, where ``max_repeats`` is set and those weights would repeat a source more often,
the smallest t above it that keeps the limit (1, the natural shares, where none does).

Each source's budget of tokens is then filled from seeded permutations of its documents.  A document
lies in one of ``blocks`` blocks of its source by hash; an epoch takes the blocks in a seeded
order, and inside a block the documents in a seeded order.  Whole epochs come first; the last one
is cut where the budget ends, inside one block.  So only (source, block) sums are ever ordered as
a whole (sources x blocks rows), and document order is needed in the one cut block of a source; there
the sums of 65,536 runs of that order are summed up first, so that a task orders one run alone.

Defined results: a null source is a source of its own; null and blank texts and rows with a null id
have no tokens and are never drawn; rows that share an id are drawn as often as the one drawn
most; an empty table gives no rows; extra columns are ignored by ``mix`` and kept by ``realise``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import Scratch

#: Up to so many sources the bisection runs on the driver, beyond it as aggregations.
LOCAL_SOURCES = 10_000
STEPS = 60


@dataclass
class Weights:
    exponent: float
    total_tokens: int
    norm: float


def token_count(text: Column) -> Column:
    """Words of a text, a word being a run of anything but 0x20 and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measures(totals: DataFrame, budget_ratio: float):
    """A function of t: (entropy, largest repetition of a source, sum of q**t); and the token sum,
    the number of sources."""
    held = totals.where("tokens > 0")
    n, total = held.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if n <= LOCAL_SOURCES:
        shares = sorted((r.tokens / total for r in held.select("tokens").collect()), reverse=True)

        def at(t: float) -> tuple[float, float, float]:
            norm = math.fsum(q**t for q in shares)
            entropy = math.fsum(-(q**t / norm) * math.log(q**t / norm) for q in shares)
            return entropy, max((q**t / norm / q * budget_ratio for q in shares), default=0.0), norm

    else:

        def at(t: float) -> tuple[float, float, float]:
            q = F.col("tokens") / F.lit(float(total))
            p = F.pow(q, F.lit(t))
            norm, dot, most = held.agg(F.sum(p), F.sum(p * F.log(p)), F.max(p / q)).first()
            return math.log(norm) - dot / norm, most / norm * budget_ratio, norm

    return at, total, n


def solve(totals: DataFrame, min_entropy: float, max_repeats: float | None, budget_ratio: float) -> Weights:
    """The exponent for per-source token totals (source, tokens)."""
    at, total, n = _measures(totals, budget_ratio)
    if n <= 1:
        return Weights(1.0, total, 1.0)

    def bisect(holds_low: bool, holds) -> float:
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            if holds(at(mid)) == holds_low:
                low = mid
            else:
                high = mid
        return low if holds_low else high

    wanted = min_entropy * math.log(n)
    t = 1.0 if at(1.0)[0] >= wanted else bisect(True, lambda m: m[0] >= wanted)
    if max_repeats is not None and at(t)[1] > max_repeats:
        t = bisect(False, lambda m: m[1] <= max_repeats) if at(1.0)[1] <= max_repeats else 1.0
    return Weights(t, total, at(t)[2])


def _order(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def mix(documents: DataFrame, scratch: Scratch, min_entropy: float = 0.97, max_repeats: float | None = 4.0, budget_ratio: float = 1.0, blocks: int = 256, seed: int = 17) -> DataFrame:
    """What is drawn of each document: doc_id, source, n_tokens, weight (its source's), epochs (how
    often it is drawn whole), last_rank (md5 order of the cut epoch, null if not in it).

    The budget of a source is the floor of weight * budget_ratio * all tokens; a document is
    drawn in the cut epoch if it ends within the budget.  The whole table is counted; no
    document is left out of the result, and those never drawn have copies 0.
    """
    counted = scratch.table(documents.select("doc_id", "source", F.when(F.col("doc_id").isNotNull(), token_count(F.col("text"))).otherwise(F.lit(0).cast("long")).alias("n_tokens")), "tokens")
    keyed = counted.withColumn("block", F.conv(F.substring(_order(seed, F.col("doc_id")), 1, 8), 16, 10).cast("long") % blocks)
    sums = scratch.table(keyed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    totals = sums.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    w = solve(totals, min_entropy, max_repeats, budget_ratio)
    q = F.col("tokens") / F.lit(float(max(1, w.total_tokens)))
    weight = F.pow(q, F.lit(w.exponent)) / F.lit(w.norm)
    budgets = totals.where("tokens > 0").select("source", F.col("tokens").alias("source_tokens"), weight.alias("weight"))
    budgets = budgets.withColumn("budget", F.floor(F.col("weight") * F.lit(budget_ratio * w.total_tokens) + F.lit(1e-6)).cast("long"))
    budgets = budgets.withColumn("epochs", F.floor(F.expr("budget / source_tokens")).cast("int"))
    budgets = budgets.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_tokens"))
    # The cut epoch: blocks in seeded order, up to the one in which the budget ends.
    null_safe = budgets.withColumnRenamed("source", "s")
    ordered = sums.join(null_safe, F.col("source").eqNullSafe(F.col("s"))).withColumn("turn", _order(seed + 1, F.col("source"), F.col("block")))
    before = F.sum("tokens").over(W.partitionBy("source").orderBy("turn", "block").rowsBetween(W.unboundedPreceding, -1))
    plan = scratch.table(ordered.select(F.col("source").alias("s"), F.col("block").alias("b"), "weight", "epochs", "turn", (F.col("rest") - F.coalesce(before, F.lit(0))).alias("left"), "tokens"), "plan")
    here = keyed.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    cut = (F.col("left") > 0) & (F.col("left") < F.col("tokens"))
    inside = _order(seed + 2, F.col("doc_id"))
    rank = F.concat(F.col("turn"), F.lit(":"), inside)
    drawn = F.col("n_tokens") > 0
    apart = F.coalesce(cut & drawn, F.lit(False))
    columns = ["doc_id", "source", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.when(drawn, F.coalesce("epochs", F.lit(0))).otherwise(0).alias("epochs")]
    whole = here.where(~apart).select(*columns, F.when(drawn & (F.col("left") >= F.col("tokens")) & (F.col("left") > 0), rank).alias("last_rank"))
    run = here.where(apart).withColumn("run", F.substring(inside, 1, 4))
    runs = run.groupBy("s", "b", "run").agg(F.sum("n_tokens").alias("run_tokens"))
    ahead = F.coalesce(F.sum("run_tokens").over(W.partitionBy("s", "b").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(F.col("s").alias("s2"), F.col("b").alias("b2"), F.col("run").alias("run2"), ahead.alias("ahead"))
    placed = run.join(starts, F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")) & (F.col("run") == F.col("run2")))
    upto = F.col("ahead") + F.sum("n_tokens").over(W.partitionBy("s", "b", "run").orderBy(rank, "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0))
    part = placed.withColumn("upto", upto).select(*columns, F.when(F.col("upto") <= F.col("left"), rank).alias("last_rank"))
    return whole.unionByName(part).withColumn("copies", F.col("epochs") + F.col("last_rank").isNotNull().cast("int"))


def realise(documents: DataFrame, drawn: DataFrame, seed: int = 17, blocks: int = 256) -> DataFrame:
    """The mixed rows: row (a struct of the document's columns), epoch (from 0) and position, the text by
    which the rows of an epoch are ordered: blocks as they are permuted, then documents in a block."""
    often = drawn.where("copies > 0").groupBy("doc_id").agg(F.max(F.struct("copies", "last_rank", "epochs")).alias("d")).select("doc_id", "d.*")
    draws = often.select("doc_id", "last_rank", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))
    joined = documents.select("doc_id", F.col("source").alias("_source"), F.struct("*").alias("row")).join(draws, "doc_id")
    block = F.conv(F.substring(_order(seed, F.col("doc_id")), 1, 8), 16, 10).cast("long") % blocks
    order = F.concat_ws(":", _order(seed + 3, F.col("epoch"), F.col("_source"), block), _order(seed + 4, F.col("epoch"), F.col("doc_id")))
    return joined.select("row", "epoch", order.alias("position"))
