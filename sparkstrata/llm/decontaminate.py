"""Benchmark decontamination by pigeonhole edit matching.

Documents and test items are compared lower-cased with whitespace runs made one space.  An item of
length L may differ by k = floor(error_rate * L) edits.  It is cut into k + 1 pieces, one of which
must occur unchanged in any text within k edits; one automaton finds all pieces of all items in
one pass over each whole document.  Around each piece found, Myers' bit-parallel algorithm gives
the smallest edit distance between the item and any substring.

Documents are never shuffled.  The items are broadcast in passes of about ``max_pass_chars``
characters each.  A benchmark that needs more than one pass has each pass collected, sent, written
to the scratch folder and released before the next, and every pass reads the documents again.

Defined results: null or blank texts match nothing, and neither do null or blank items; items with
equal ids are searched each and the best distance counts; documents with equal ids each give their
own rows; very long texts are searched whole; an empty benchmark or table gives no rows; extra
columns are ignored, whatever their names (``drop_leaks`` keeps them).  The Python workers need ``ahocorasick``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

ERROR_RATE = 0.05
MAX_PASS_CHARS = 16_000_000


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in errors + 1 runs of nearly equal length, each with its offset."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of the pattern to any substring of the text (with ``anchored``, to any prefix),
    and that substring's end (the first such); bit i of the vectors stands for pattern[i]."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | (1 << i)
    plus, minus, score, best, end, first = mask, 0, m, m, 0, int(anchored)
    for j, c in enumerate(text):
        eq = equal.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(xh | plus) & mask)
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
        up = ((up << 1) | first) & mask
        down = (down << 1) & mask
        plus = down | (~(xv | up) & mask)
        minus = up & xv
    return best, end


class Matcher:
    """Searches texts for items: (id, normalised text) pairs."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = [(i, t, int(error_rate * len(t))) for i, t in items if t]
        found: dict[str, list[tuple[int, int]]] = {}
        for at, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                found.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best match of each item in a normalised text: of those with the
        least distance the one that ends first, and of its starts the last."""
        if not self.items or not text:
            return []
        regions: dict[int, list[list[int]]] = {}
        for last, (n, places) in self.automaton.iter(text):
            for at, offset in places:
                _, item, errors = self.items[at]
                start = last + 1 - n - offset
                a, b = max(0, start - errors), min(len(text), start + len(item) + errors)
                known = regions.setdefault(at, [])
                if known and a <= known[-1][1] and a >= known[-1][0]:
                    known[-1][1] = max(known[-1][1], b)
                else:
                    known.append([a, b])
        best: dict[int, tuple[int, int, int]] = {}
        for at, spans in regions.items():
            key, item, errors = self.items[at]
            for a, b in spans:
                if (exact := text.find(item, a, b)) >= 0:
                    distance, end = 0, exact + len(item)
                else:
                    distance, end = myers(item, text[a:b])
                    end += a
                if distance <= errors and (key not in best or (distance, end) < (best[key][0], best[key][2])):
                    start = end - len(item)
                    if distance and not first_only:  # the same search backwards from the end
                        reach = text[max(0, start - errors) : end]
                        start = end - myers(item[::-1], reach[::-1], anchored=True)[1]
                    best[key] = (distance, start, end)
                    if first_only:
                        return [(key, *best[key])]
                if key in best and not best[key][0]:
                    break
        return [(key, *found) for key, found in sorted(best.items())]


def _passes(benchmark: DataFrame, max_pass_chars: int) -> Iterator[tuple[bool, list[tuple[int, str]]]]:
    """(whether it is the last, items) in lists of bounded size; each is collected when it is asked for."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-chars * 2 // max_pass_chars) if chars > max_pass_chars else 1)
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield i + 1 == n, sorted((r.item_id, normalise(r.text)) for r in part.collect())


def _each_pass(documents: DataFrame, benchmark: DataFrame, max_pass_chars: int, step: Callable[[DataFrame, object], DataFrame], chain: bool) -> DataFrame:
    """``step(documents, broadcast items)`` of every pass: on what the last one left (``chain``), or all their rows.
    Only the last pass is left to be run later, so that at most one broadcast lives."""
    sc = documents.sparkSession.sparkContext
    scratch, out, now = None, None, documents
    for last, items in _passes(benchmark, max_pass_chars):
        shared = sc.broadcast(items)
        part = step(now, shared)
        if not last:
            scratch = scratch or Scratch(documents.sparkSession, "leaks")
            part = scratch.table(part, "pass")
            shared.destroy()
        if chain:
            now = part
        out = part if out is None or chain else out.unionByName(part)
    return out


MATCHES = "doc_id long, item_id long, distance int, match_start int, match_end int"


def find_leaks(documents: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, max_pass_chars: int = MAX_PASS_CHARS) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, distance (edits), match_start
    and match_end (offsets in the normalised text)."""

    def searching(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate)
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for k, text in enumerate(batch.column(1)):
                    for hit in matcher.search(normalise(text.as_py())):
                        rows.append((ids[k], *hit))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "distance", "match_start", "match_end"])

        return run

    step = lambda docs, shared: docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(searching(shared), MATCHES)
    return _each_pass(documents, benchmark, max_pass_chars, step, chain=False)


def drop_leaks(documents: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, max_pass_chars: int = MAX_PASS_CHARS) -> DataFrame:
    """The documents, whole and unshuffled, in which no item is found."""

    def clean_of(shared) -> Callable:
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(shared.value, error_rate)
            for texts in batches:
                yield pd.Series([not matcher.search(normalise(t), first_only=True) for t in texts], dtype=bool)

        clean.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(clean, "boolean")

    step = lambda docs, shared: docs.where(clean_of(shared)(F.col("text")))
    return _each_pass(documents, benchmark, max_pass_chars, step, chain=True)
