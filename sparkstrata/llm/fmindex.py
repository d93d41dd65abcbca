"""A compressed FM-index over words: k-ordered suffixes, a wavelet matrix and backward search.

The text is the concatenation of segments of words (as numbers) with a separator after each.  Suffixes are
ordered by their first ``window`` words, which is all that backward search for patterns of up to
``window`` words needs.  The Burrows-Wheeler transform is kept as a wavelet matrix: one packed
bit vector and one sampled rank directory a level.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of any symbol over a sequence, in packed bits."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n = len(symbols)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        now = symbols.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.bits.append(packed)
            self.ones.append(counts)
            self.zeros.append(self.n - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        symbol = np.arange(sigma, dtype=np.uint32)
        self.first = self._follow(symbol, np.zeros(sigma, np.int64))

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            bit = (symbol >> np.uint32(self.levels - 1 - i)) & np.uint32(1)
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[i][word] + np.bitwise_count(self.bits[i][word] & below)
            at = np.where(bit == 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._follow(symbol, at) - self.first[symbol]


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a, b), equal pairs sharing one."""
    key = a.astype(np.int64) * (int(b.max()) + 1) + b
    order = np.argsort(key, kind="stable")
    key = key[order]
    step = np.zeros(len(key), np.int64)
    step[1:] = key[1:] != key[:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(step)
    return out


def prefix_ranks(text: np.ndarray, k: int) -> np.ndarray:
    """The rank of every suffix by its first k symbols (the text's end counts as symbol 0)."""
    rank, known = text, 1
    while known < k:
        step = min(known, k - known)
        ahead = np.zeros(len(text), np.int64)
        ahead[:-step] = rank[step:]
        rank, known = _dense(rank, ahead), known + step
    return rank


class FMIndex:
    def __init__(self, words: np.ndarray, starts: np.ndarray, window: int):
        """words: symbols of all segments, one after another; starts: first word of each, and the end."""
        _, ids = np.unique(words, return_inverse=True)
        self.window, n_segments = window, len(starts) - 1
        lengths = np.diff(starts)
        self.segment = np.repeat(np.arange(n_segments), lengths)
        self.at = np.arange(len(words)) + self.segment  # of each word, with separators counted
        self.text = np.zeros(len(words) + n_segments, np.int64)
        self.text[self.at] = ids + 1
        order = np.argsort(prefix_ranks(self.text, window), kind="stable")
        owner = np.repeat(np.arange(n_segments), lengths + 1)
        self.owner = owner[order]
        sigma = int(self.text.max(initial=0)) + 1
        counts = np.bincount(self.text, minlength=sigma)
        self.below = np.concatenate([[0], np.cumsum(counts)])
        self.bwt = WaveletMatrix(self.text[order - 1], sigma)

    def matching_statistics(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from the word at each text position of ``ends``, up to ``window`` words:
        the suffix interval (low, high) and the length reached.  A search stops as soon as its
        interval holds one suffix, its own, so a length below ``window`` means no second occurrence
        of the window."""
        symbol = self.text[ends]
        low, high = self.below[symbol], self.below[symbol + 1]
        length = np.ones(len(ends), np.int64)
        live = np.flatnonzero(high - low > 1)
        for step in range(1, self.window):
            if not len(live):
                break
            symbol = self.text[ends[live] - step].astype(np.uint32)
            both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            base = self.below[symbol]
            low[live], high[live] = base + both[: len(live)], base + both[len(live) :]
            length[live] += 1
            live = live[high[live] - low[live] > 1]
        return low, high, length

    def smallest_owner(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every window of every segment: its segment, the offset of its first word there, and the
        least ``value`` (one for each segment) among all segments in which it occurs."""
        w = self.window
        starts = np.searchsorted(self.segment, np.arange(int(self.segment[-1]) + 1)) if len(self.segment) else np.zeros(0, np.int64)
        last = np.flatnonzero(self.at - (starts + np.arange(len(starts)))[self.segment] >= w - 1) if len(self.segment) else np.zeros(0, np.int64)
        segment = self.segment[last]
        offset = last - starts[segment] - (w - 1)
        least = value[segment].copy()
        low, high, length = self.matching_statistics(self.at[last])
        met = np.flatnonzero((length == w) & (high - low > 1))
        if len(met):
            spans, which = np.unique(low[met] * np.int64(len(self.text) + 1) + high[met], return_inverse=True)
            a, b = spans // (len(self.text) + 1), spans % (len(self.text) + 1)
            values = np.append(value[self.owner], np.iinfo(np.int64).max)
            least[met] = np.minimum.reduceat(values, np.stack([a, b], 1).ravel())[::2][which]
        return segment, offset, least
