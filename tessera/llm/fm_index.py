"""A compressed full-text index over sequences of integers: Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Packed bits with counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def __call__(self, i: np.ndarray) -> np.ndarray:
        """The number of ones among the first i bits."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class FMIndex:
    """Counts occurrences of patterns of at most ``depth`` symbols, not 0, in ``text``, whose last symbol is 0.

    Suffixes are sorted by their first ``depth`` symbols only, which is enough for patterns that long.
    """

    def __init__(self, text: np.ndarray, depth: int = 64):
        self.text = text = text.astype(np.int64)
        n = len(text)
        rank, k = text, 1
        while k < depth and n:
            after = np.zeros(n, np.int64)
            after[: max(n - k, 0)] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2) + after
            values, rank = np.unique(key, return_inverse=True)
            rank = rank.astype(np.int64)
            if len(values) == n:
                break
            k *= 2
        order = np.argsort(rank, kind="stable")
        bwt = text[order - 1]
        self.n, sigma = n, int(text.max(initial=0)) + 1
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:-1]
        self.levels, self.zeros = [], []
        self.bits = max(1, (sigma - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.levels.append(BitRank(bit))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
            self.zeros.append(int(n - bit.sum()))
        self.base = self.starts - self._map(np.arange(sigma), np.zeros(sigma, np.int64))

    def _map(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (rank, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbols >> (self.bits - 1 - k)) & 1
            r = rank(i)
            i = np.where(one == 1, zeros + r, i - r)
        return i

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of the patterns with one more symbol in front."""
        m = len(symbols)
        both = self._map(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        base = self.base[symbols]
        return both[:m] + base, both[m:] + base

    def matching(self, symbols: np.ndarray, ends: np.ndarray, floors: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each end the least j, not below its floor, such that symbols[j : end + 1] occurs ``least`` times or more (end + 1: none)."""
        j = ends + 1
        live = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        while len(live):
            a, b = self.extend(symbols[j[live] - 1], low, high)
            ok = b - a >= least[live]
            live, low, high = live[ok], a[ok], b[ok]
            j[live] -= 1
            more = j[live] > floors[live]
            live, low, high = live[more], low[more], high[more]
        return j
