"""Substring dedup: words in passages that an earlier document already has.

A window is ``window`` consecutive words.  Each word covered by a window that also occurs in a
document with a smaller doc_id is removed, judged on the input.

Shards are made of content, so that each text is searched in one shard only.  Of each window the
least hash of its runs of ``anchor_words`` words is its anchor; consecutive windows with one
anchor make a segment, and equal windows have equal anchors wherever they stand.  Anchors that
only one document has can't match and are dropped by an aggregation on anchors alone.  The other
segments go, sorted by anchor, to tasks that cut the stream into shards of about
``shard_words`` words, build the compressed FM-index of a shard, stream its segments through
backward search and report the intervals of windows that an earlier document has.

Rows that copy the whole text of an earlier document are set apart first (on digests); their windows are
all that text's, so only one copy is indexed and searched.

An anchor with more than ``hot_rows`` segments (a passage that very many documents share), or with more than
``hot_windows`` windows in them (lines repeated over and over), would make too large a shard.  Its segments are
cut into pieces of at most ``piece`` windows instead, and equal pieces are merged before the shuffle; only the
different ones are cut further, into their different windows, of which those of pieces with different first
documents go through the same index by the window's own hash.  Every document after the first with a piece loses
the piece whole, and the first loses the windows found earlier still, so that the documents of a group send one row
a piece, by its 128-bit digest, and not one a window.  So no task holds an unbounded group, and no window is
left out.

Defined results: null and short texts have no windows; rows that share a doc_id never remove each
other's words, and equal ones get equal results; rows with a null doc_id are left alone and remove
nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .textwords import byte_codes, chunks, hashes, one_batch, sequence_hashes, spans

WINDOW = 13
ANCHOR_WORDS = 4
SHARD_WORDS = 1 << 17
HOT_ROWS = 4096
HOT_WINDOWS = 1 << 18
PIECE_WINDOWS = 256


def _row_windows(doc: np.ndarray, word: np.ndarray, window: int, anchor_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that start a window within one row, and the anchors there."""
    n = len(word) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = sequence_hashes(word, anchor_words)
    wide, have = window - anchor_words + 1, 1
    least = gram
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return inside, least[inside]


def _segments(raw: np.ndarray, at: np.ndarray, codes: np.ndarray, window: int, anchor_words: int):
    """Of a run of rows: row, anchor, ordinal within the row, first word within the row and number
    of windows of every segment."""
    start, end, doc = spans(raw, at)
    return _segments_of(start, end, doc, raw, codes, window, anchor_words)


def _segments_of(start: np.ndarray, end: np.ndarray, doc: np.ndarray, raw: np.ndarray, codes: np.ndarray, window: int, anchor_words: int):
    word = hashes(raw, start, end, codes)
    inside, anchor = _row_windows(doc, word, window, anchor_words)
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    owner = doc[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    row = owner[first]
    count = np.diff(np.append(first, len(inside)))
    ordinal = np.arange(len(first)) - np.searchsorted(row, row, "left")
    word_zero = np.searchsorted(doc, row, "left")
    return row, anchor[first], ordinal, inside[first] - word_zero, count


def _originals(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pa.compute.and_(pa.compute.is_valid(batch.column(0)), pa.compute.is_null(batch.column(4))))


def _anchors(window: int, anchor_words: int, with_place: bool):
    """mapInArrow: (doc_id, text_key, text, carried, copy) to one row a segment: anchor, doc_id, place; the
    place packs the ordinal and 32 bits of the text's hash.  Without it, equal anchors of a document are
    sent once, with the number of their windows.  Copies and rows without an id are passed over here, not by a filter: with the same
    columns and rows before every use, Spark shuffles the texts once and reuses the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(lower=False)
        for batch in batches:
            batch = _originals(batch)
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for base, raw, at in chunks(batch.column(2)):
                row, anchor, ordinal, _, count = _segments(raw, at, codes, window, anchor_words)
                if with_place:
                    place = (ordinal << 32) | keys[base + row]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ids[base + row]), pa.array(place)], names=["anchor", "doc_id", "place"])
                else:
                    order = np.lexsort((row, anchor))
                    new = np.ones(len(order), bool)
                    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (row[order][1:] != row[order][:-1])
                    keep = order[new]
                    n = np.add.reduceat(count[order], np.flatnonzero(new)) if len(order) else count
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[keep].view(np.int64)), pa.array(ids[base + row[keep]]), pa.array(n.astype(np.int64))], names=["anchor", "doc_id", "windows"])

    return run


def _gather(raw: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The byte ranges [low, high) as a binary array."""
    size = high - low
    at = np.append(0, np.cumsum(size))
    data = raw[np.repeat(low - at[:-1], size) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


SEGMENTS = "shard long, doc_id long, text_key long, start int, words binary"
#: What _cut gives of hot segments: the different pieces, or where each of them stands.
PIECES, PLACES = "words binary, low long, high long", "piece binary, doc_id long, text_key long, start int, windows int"
#: What _windows gives of the different pieces: their windows, or the starts of each within its piece.
WINDOWS, STARTS = "words binary, low long, high long", "digest binary, piece binary, low long, starts array<int>"


def _digest(words: bytes) -> bytes:
    return hashlib.sha256(words).digest()[:16]


def _digests(words: pa.Array) -> pa.Array:
    return pa.array([_digest(x) for x in words.to_pylist()], pa.binary())


def _distinct(data: pa.Array, ids: np.ndarray) -> pa.RecordBatch:
    """The different values of ``data`` with the smallest and the largest of their ids."""
    coded = data.dictionary_encode()
    which, n = coded.indices.to_numpy(), len(coded.dictionary)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, which, ids)
    np.maximum.at(high, which, ids)
    return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(low), pa.array(high)], names=["words", "low", "high"])


def _cut(window: int, anchor_words: int, hot: str = "", piece: int = PIECE_WINDOWS):
    """mapInArrow: (doc_id, text_key, text, carried, copy, ordinals) to the words of the segments named; hot ones
    (ordinals below zero: -1 - ordinal) in pieces of at most ``piece`` windows, as PIECES or PLACES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(lower=False)
        for batch in batches:
            batch = _originals(batch)
            batch = batch.filter(pa.compute.is_valid(batch.column(5)))
            if not batch.num_rows:
                continue
            some = batch.column(5).flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(5).offsets.to_numpy()))
            named = np.zeros(batch.num_rows, bool)
            named[of[some < 0 if hot else some >= 0]] = True
            if not named.any():
                continue
            batch = batch.filter(pa.array(named))  # only texts with such segments are cut again
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, wanted = batch.column(2), batch.column(5)
            for base, raw, at in chunks(texts):
                start, end, doc = spans(raw, at)
                row, anchor, ordinal, first, count = _segments_of(start, end, doc, raw, codes, window, anchor_words)
                edge = np.searchsorted(row, np.arange(len(at)))
                part = wanted.slice(base, len(at) - 1)
                some = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(len(at) - 1), np.diff(part.offsets.to_numpy()))
                here = some < 0 if hot else some >= 0
                some, of = some[here], of[here]
                if not len(some):
                    continue
                s = edge[of] + (-1 - some if hot else some)
                a, n = first[s], count[s]
                shard = anchor[s].view(np.int64)
                if hot:
                    parts = -(-n // piece)
                    within = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * piece
                    a, of, n = np.repeat(a, parts) + within, np.repeat(of, parts), np.minimum(np.repeat(n, parts) - within, piece)
                word = np.searchsorted(doc, of) + a
                low, high = start[word], end[word + n + window - 2]
                data = _gather(raw, low, high)
                if hot:  # pieces are merged by their bytes, so white space is made one space
                    coded = data.dictionary_encode()
                    distinct, which = pa.array([b" ".join(x.split()) for x in coded.dictionary.to_pylist()], pa.binary()), coded.indices
                    if hot == PIECES:
                        yield _distinct(distinct.take(which), ids[base + of])
                    else:
                        yield pa.RecordBatch.from_arrays([_digests(distinct).take(which), pa.array(ids[base + of]), pa.array(keys[base + of]), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32))], names=["piece", "doc_id", "text_key", "start", "windows"])
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids[base + of]), pa.array(keys[base + of]), pa.array(a.astype(np.int32)), data], names=["shard", "doc_id", "text_key", "start", "words"])

    return run


def _windows(window: int, give: str):
    """mapInArrow over the different pieces (words, low, high) of hot segments: their windows, as WINDOWS, with the
    first document of each piece for low and high; or, as STARTS, where each different window stands in its piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(1).to_numpy()
            for base, raw, at in chunks(batch.column(0)):
                start, end, piece = spans(raw, at)
                word = np.flatnonzero(piece[: len(piece) - window + 1] == piece[window - 1 :])
                of = piece[word]
                data = _gather(raw, start[word], end[word + window - 1])
                if give == WINDOWS:
                    yield _distinct(data, first[base + of])
                    continue
                coded = data.dictionary_encode()
                which = coded.indices.to_numpy()
                order = np.lexsort((which, of))
                new = np.ones(len(order), bool)
                new[1:] = (which[order][1:] != which[order][:-1]) | (of[order][1:] != of[order][:-1])
                at_piece, edge = of[order][new], np.append(np.flatnonzero(new), len(order))
                starts = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array((word - np.searchsorted(piece, of))[order].astype(np.int32)))
                digest = _digests(coded.dictionary).take(pa.array(which[order][new]))
                owner = _digests(batch.column(0).slice(base, len(at) - 1)).take(pa.array(at_piece))
                yield pa.RecordBatch.from_arrays([digest, owner, pa.array(first[base + at_piece]), starts], names=["digest", "piece", "low", "starts"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over the different pieces: their digests, low and high.  Not a column expression: Spark would push the
    join's filter on it below the aggregate that makes the pieces, and shuffle them once more."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_digests(batch.column(0)), batch.column(1), batch.column(2)], names=["piece", "low", "high"])


def _shards(batches: Iterator[pa.RecordBatch], column: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """The stream, sorted by its first column, in runs of about ``shard_words`` words that never part equal keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        shard = batch.column(0).to_numpy()
        change = np.flatnonzero(shard[1:] != shard[:-1]) + 1
        if held and len(shard) and held[-1].column(0)[-1].as_py() != shard[0]:
            change = np.append(0, change)
        lengths = np.append(0, np.cumsum(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False) // 6))
        done = 0
        for cut in change:
            if size + lengths[cut] - lengths[done] >= shard_words:
                if cut > done:
                    held.append(batch.slice(done, cut - done))
                if held:
                    yield one_batch(held)
                held, size, done = [], 0, cut
        if done < len(shard):
            held.append(batch.slice(done))
            size += lengths[-1] - lengths[done]
    if held:
        yield one_batch(held)


def _indexed(words: pa.Array, ids: np.ndarray, window: int):
    """Index the distinct values of ``words`` and stream them through it: which distinct value
    each row has, and for each window (value, offset, least id).  The index's symbols stand for
    the bytes of words, not for their hashes, so what it finds is equal to the byte."""
    coded = words.dictionary_encode()
    which, distinct = coded.indices.to_numpy(), coded.dictionary
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    found, sizes = [pa.array([], pa.binary())], [np.zeros(0, np.int64)]
    for _, raw, at in chunks(distinct):
        start, end, doc = spans(raw, at)
        found.append(_gather(raw, start, end))
        sizes.append(np.bincount(doc, minlength=len(at) - 1))
    starts = np.append(0, np.cumsum(np.concatenate(sizes)))
    symbols = pa.concat_arrays(found).dictionary_encode().indices.to_numpy()
    return which, FMIndex(symbols.astype(np.int64), starts, window).smallest_owner(least)


def _search(window: int, shard_words: int):
    """mapInArrow over sorted segments: doc_id, text_key and the word interval [start, stop) of each
    run of windows that a smaller doc_id has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, 4, shard_words):
            ids, keys, first = (shard.column(i).to_numpy() for i in (1, 2, 3))
            which, (value, offset, least) = _indexed(shard.column(4), ids, window)
            begin = np.searchsorted(value, np.arange(int(value[-1]) + 2))
            count = np.diff(begin)[which]
            row = np.repeat(np.arange(len(which)), count)
            within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            hit = least[begin[which][row] + within] < ids[row]
            row, within = row[hit], within[hit]
            new, last = np.ones(len(row), bool), np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (within[1:] != within[:-1] + 1)
            last[:-1] = new[1:]
            row, a, b = row[new], within[new], within[last]
            start = (first[row] + a).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(keys[row]), pa.array(start), pa.array((first[row] + b + window).astype(np.int32))], names=["doc_id", "text_key", "start", "stop"])

    return run


def _search_windows(window: int, shard_words: int):
    """mapInArrow over (shard, words, doc_id) of distinct windows: their digests and the smallest doc_id that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, 1, shard_words):
            which, (value, _, least) = _indexed(shard.column(1), shard.column(2).to_numpy(), window)
            order = np.empty(len(value), np.int64)
            order[value] = np.arange(len(value))
            yield pa.RecordBatch.from_arrays([_digests(shard.column(1)), pa.array(least[order[which]])], names=["digest", "earliest"])

    return run


def _copies(keyed: DataFrame) -> DataFrame:
    """doc_id, text_key, copy (true) of rows whose whole text a smaller doc_id has; found on digests, merged
    before the shuffle."""
    ids = keyed.where("doc_id is not null and text is not null").select("doc_id", "text_key", F.unhex(F.sha2("text", 256)).alias("digest"))
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    return ids.join(first, "digest").where("doc_id > first").select("doc_id", "text_key").distinct().withColumn("copy", F.lit(True))


def repeated_spans(keyed: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS, shard_words: int = SHARD_WORDS, hot_rows: int = HOT_ROWS, hot_windows: int = HOT_WINDOWS, piece: int = PIECE_WINDOWS) -> DataFrame:
    """doc_id, text_key, spans (array of struct(start, stop) in words, that may overlap) of the rows
    of ``keyed`` (doc_id, text_key, text, carried, copy) that have words to remove.  Rows marked as copies of a
    whole earlier text are neither indexed nor streamed: every window of theirs is that text's."""
    places = keyed.mapInArrow(_anchors(window, anchor_words, True), "anchor long, doc_id long, place long")
    anchors = keyed.mapInArrow(_anchors(window, anchor_words, False), "anchor long, doc_id long, windows long").groupBy("anchor")
    shared = anchors.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("rows"), F.sum("windows").alias("windows")).where("low < high")
    shared = shared.select("anchor", ((F.col("rows") > hot_rows) | (F.col("windows") > hot_windows)).alias("hot"))
    ordinal = F.shiftright("place", 32).cast("int")
    named = places.join(shared, "anchor").select("doc_id", F.col("place").bitwiseAND(0xFFFFFFFF).alias("text_key"), F.when(F.col("hot"), -1 - ordinal).otherwise(ordinal).alias("o"))
    wanted = named.groupBy("doc_id", "text_key").agg(F.collect_list("o").alias("ordinals"))
    texts = keyed.join(wanted, ["doc_id", "text_key"], "left")
    cold = texts.mapInArrow(_cut(window, anchor_words), SEGMENTS)
    cold = cold.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search(window, shard_words), "doc_id long, text_key long, start int, stop int")
    cold = cold.select("doc_id", "text_key", F.array(F.struct("start", "stop")).alias("spans"))
    pieces = texts.mapInArrow(_cut(window, anchor_words, PIECES, piece), PIECES).groupBy("words").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    merged = pieces.mapInArrow(_windows(window, WINDOWS), WINDOWS).groupBy("words").agg(F.min("low").alias("doc_id"), F.max("high").alias("high")).where("doc_id < high")
    merged = merged.select(F.xxhash64("words").alias("shard"), "words", "doc_id")
    found = merged.sortWithinPartitions("shard").mapInArrow(_search_windows(window, shard_words), "digest binary, earliest long")
    earlier = pieces.mapInArrow(_windows(window, STARTS), STARTS).join(found, "digest").where("earliest < low")
    earlier = earlier.groupBy("piece").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    known = pieces.mapInArrow(_named, "piece binary, low long, high long").join(earlier, "piece", "left").where("low < high or starts is not null")
    hot = texts.mapInArrow(_cut(window, anchor_words, PLACES, piece), PLACES).join(known, "piece").where("doc_id > low or starts is not null")
    whole = F.array(F.struct("start", (F.col("start") + F.col("windows") + (window - 1)).alias("stop")))
    some = F.transform("starts", lambda at: F.struct((F.col("start") + at).alias("start"), (F.col("start") + at + window).alias("stop")))
    hot = hot.select("doc_id", "text_key", F.when(F.col("doc_id") > F.col("low"), whole).otherwise(some).alias("spans"))
    return cold.unionByName(hot).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _keyed(documents: DataFrame, carry: list[str]) -> DataFrame:
    """doc_id, text_key, text, carried (struct of the columns named), copy."""
    carried = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(True)
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").bitwiseAND(0xFFFFFFFF).alias("text_key"), "text", carried.alias("carried"))
    return plain.join(_copies(plain.drop("carried")), ["doc_id", "text_key"], "left")


def _kept_mask(n: int, spans, copy: bool, window: int) -> np.ndarray:
    if copy:
        return np.full(n, n < window)
    edge = np.zeros(n + 1, np.int64)
    if spans is not None:
        flat = spans.values
        np.add.at(edge, np.minimum(flat.field("start").to_numpy(), n), 1)
        np.add.at(edge, np.minimum(flat.field("stop").to_numpy(), n), -1)
    return np.cumsum(edge[:-1]) == 0


def removal_digests(documents: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of every row."""
    window = parameters.get("window", WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, digests = [], [], []
            for text, found, copy in zip(batch.column(2), batch.column(5), batch.column(4).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                if found.is_valid or copy:
                    mask = _kept_mask(n, found, copy, window)
                    words = list(compress(words, mask.tolist()))
                sizes.append(n)
                removed.append(n - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    keyed = _keyed(documents, [])
    return keyed.join(repeated_spans(keyed, **parameters), ["doc_id", "text_key"], "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(documents: DataFrame, **parameters) -> DataFrame:
    """The documents with repeated passages cut out; texts without any stay as they are, to the byte.
    A cut takes the white space after its words too; n_chars, if there, is counted again."""
    window = parameters.get("window", WINDOW)

    def cut(texts: pd.Series, starts: pd.Series, stops: pd.Series, copies: pd.Series) -> pd.Series:
        word = re.compile(rb"[^\x20\x09-\x0d]+")
        out = []
        for text, first, last, copy in zip(texts, starts, stops, copies, strict=True):
            if text is None or (not copy and (first is None or not len(first))):
                out.append(text)
                continue
            raw = text.encode()
            begins = [m.start() for m in word.finditer(raw)]
            if copy:
                keep = [len(begins) < window] * len(begins)
            else:
                edge = np.zeros(len(begins) + 1, np.int64)
                np.add.at(edge, np.minimum(first, len(begins)), 1)
                np.add.at(edge, np.minimum(last, len(begins)), -1)
                keep = np.cumsum(edge[:-1]) == 0
            ends = [*begins[1:], len(raw)]
            lead = raw[: begins[0]] if begins else raw
            out.append((lead + b"".join(raw[a:b] for a, b, k in zip(begins, ends, keep, strict=True) if k)).decode())
        return pd.Series(out, dtype=object)

    cut.__annotations__ = {"texts": pd.Series, "starts": pd.Series, "stops": pd.Series, "copies": pd.Series, "return": pd.Series}
    # The struct travels whole through every use of the texts, so that all share one exchange.
    keyed = _keyed(documents, [c for c in documents.columns if c != "text"])
    joined = keyed.join(repeated_spans(keyed, **parameters), ["doc_id", "text_key"], "left")
    copy = F.coalesce("copy", F.lit(False))
    touched = copy | F.col("spans").isNotNull()
    made = joined.select("carried", F.when(touched, F.pandas_udf(cut, "string")("text", "spans.start", "spans.stop", copy)).otherwise(F.col("text")).alias("text"), touched.alias("touched"))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("touched"), F.length("text").cast("long")).otherwise(F.col("carried.n_chars")) if "n_chars" in documents.columns else None}
    return made.select(*((changed[c] if c in changed else F.col(f"carried.`{c}`")).alias(c) for c in documents.columns))
