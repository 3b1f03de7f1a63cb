"""FM-index over integer symbols: wavelet-tree ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling. The last symbol is the only 0."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1 if k < n else 0
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[0] = 0
        np.cumsum(key[1:] != key[:-1], out=fresh[1:])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        k *= 2


class BitRank:
    """Bits packed in 64s with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in the first i bits."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletTree:
    """Level by level: each level sorts stably by one binary digit, highest first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.height = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        at = symbols
        for level in range(self.height - 1, -1, -1):
            bits = (at >> level) & 1
            self.levels.append(BitRank(bits))
            self.zeros.append(len(at) - int(bits.sum()))
            at = np.concatenate([at[bits == 0], at[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in the first i places."""
        start = np.zeros_like(i)
        for depth, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.height - 1 - depth)) & 1 == 1
            ri, rs = level.rank(i), level.rank(start)
            i, start = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rs, start - rs)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one = level.get(i)
            r = level.rank(i)
            i = np.where(one, zeros + r, i - r)
            symbol = symbol * 2 + one
        return symbol


class FMIndex:
    """symbols: ints of 1 and up; 0 ends the text."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 8):
        text = np.r_[symbols, 0].astype(np.int64)
        suffixes = suffix_array(text)
        self.n, self.sample = len(text), sample
        self.tree = WaveletTree(text[suffixes - 1], sigma)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        self.marked = BitRank(suffixes % sample == 0)
        self.sampled = suffixes[suffixes % sample == 0]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows, left-aligned) at once: rows lo to hi of the suffix order."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= step) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, lengths[live] - step]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back in the text until a sampled suffix."""
        at, steps = rows.copy(), np.zeros_like(rows)
        open_ = np.flatnonzero(~self.marked.get(at))
        while len(open_):
            row = at[open_]
            c = self.tree.access(row)
            at[open_] = self.before[c] + self.tree.rank(c, row)
            steps[open_] += 1
            open_ = open_[~self.marked.get(at[open_])]
        return self.sampled[self.marked.rank(at)] + steps
