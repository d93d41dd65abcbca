"""Words of whole texts and their 64-bit hashes, in numpy over Arrow's buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  Each byte and its place in the word
give 64 pseudo-random bits (tabulation hashing); a word's hash mixes their sum and its length, so it
depends on the word's bytes alone and no relation between texts makes two sums equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 17
#: Places of a word whose bytes' codes are tabulated; those further on are computed.
PLACES = 32
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _at_place(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(code ^ mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP)))


def byte_codes(lower: bool) -> np.ndarray:
    """PLACES + 1 rows of 64-bit codes for each byte: at each place, then free of places; with
    ``lower``, A-Z get the codes of a-z."""
    b = np.arange(256, dtype=np.uint64)
    if lower:
        b[65:91] += np.uint64(32)
    free = mix((b + np.uint64(1)) * np.uint64(_BASE))
    return np.concatenate([_at_place(free[None, :], np.arange(PLACES)[:, None]), free[None, :]])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows of about CHUNK_BYTES; a longer row stands alone."""
    if not len(column):
        return
    raw, at = string_buffers(column)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def spans(raw: np.ndarray, at: np.ndarray, dark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of every word, in order.  dark: which bytes are part of words, if
    not those outside the white space."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    if dark is None:
        dark = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    begins = dark.copy()
    begins[1:] &= ~dark[:-1] | edge[1:-1]
    ends = dark.copy()
    ends[:-1] &= ~dark[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(at, start, "right") - 1


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes (none is empty); CHUNK_BYTES of them are in work at a time."""
    size = end - start
    edge = np.append(0, np.cumsum(size))
    total, table = np.zeros(len(size), np.uint64), codes.reshape(-1)
    for low in range(0, int(edge[-1]), CHUNK_BYTES):
        high = min(low + CHUNK_BYTES, int(edge[-1]))
        a, b = np.searchsorted(edge, low, "right") - 1, np.searchsorted(edge, high, "left")
        first = np.maximum(edge[a:b], low)
        count = np.minimum(edge[a + 1 : b + 1], high) - first
        place = np.arange(low, high) - np.repeat(edge[a:b], count)
        byte = raw[place + np.repeat(start[a:b], count)].astype(np.int64)
        code = table[np.minimum(place, PLACES) * 256 + byte]
        if (far := np.flatnonzero(place >= PLACES)).size:
            code[far] = _at_place(code[far], place[far])
        total[a:b] += np.add.reduceat(code, first - low)
    return mix(total + size.astype(np.uint64) * np.uint64(_BASE))


def sequence_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position on (len - n + 1 of them)."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(word) - n + 1, dtype=np.uint64)
    for i in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + word[i : len(word) - n + 1 + i]
    return mix(h)


def one_batch(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The batches as one; an error, never a shorter batch, where they don't fit into one."""
    table = pa.Table.from_batches(held).combine_chunks().to_batches()
    if len(table) != 1:
        raise OverflowError(f"{sum(b.nbytes for b in held)} bytes do not fit into one batch")
    return table[0]
