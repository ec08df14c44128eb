"""An FM-index over word ids: suffix array, wavelet-matrix ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of ids of 1 and more. Prefix doubling that starts from as many ids as fit a 62-bit key and then
    sorts only suffixes that are not yet told apart."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = int(s.max()).bit_length()
    k = max(1, 62 // bits)
    key, ext = np.zeros(n, np.int64), np.concatenate([s.astype(np.int64), np.zeros(k, np.int64)])
    for j in range(k):
        key = (key << bits) | ext[j : j + n]
    sa = np.argsort(key, kind="stable")
    return refine(sa, key[sa], k)


def refine(sa: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """sa is in order by the first k ids (keys: theirs, in that order); orders it by whole suffixes."""
    n = len(sa)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # of each slot: where its group starts
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = group, -1
    while True:
        single = new & np.concatenate([new[1:], [True]])
        u = np.flatnonzero(~single)
        if not len(u):
            return sa
        at = sa[u]
        second = rank[np.minimum(at + k, n)] + 1
        order = np.argsort(group[u] * (n + 2) + second, kind="stable")
        at, second, g = at[order], second[order], group[u]
        sa[u] = at
        new[u] = np.concatenate([[True], (second[1:] != second[:-1]) | (g[1:] != g[:-1])])
        group[u] = np.maximum.accumulate(np.where(new[u], u, 0))
        rank[at] = group[u]
        k *= 2


class FMIndex:
    """Of a sequence of ids from 1 to sigma. Every rate-th position of the sequence is kept in the sample."""

    def __init__(self, s: np.ndarray, sigma: int, rate: int = 8):
        n = len(s)
        self.n = n + 1  # an end mark of id 0 follows
        sa = np.concatenate([[n], suffix_array(s)])
        bwt = np.concatenate([s, [0]])[sa - 1]  # sa 0 takes the end mark
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=sigma + 2))])
        self.levels, self.zeros = [], []
        seq = bwt
        for b in range(int(sigma).bit_length() - 1, -1, -1):
            bit = (seq >> b) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(bit) - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.bits = len(self.levels)
        kept = sa % rate == 0
        self.sampled = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])  # rank of sampled rows
        self.positions, self.is_sampled = sa[kept], kept
        self.origin = self._down(np.arange(sigma + 2), np.zeros(sigma + 2, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where prefix i of the sequence ends among c, in the wavelet matrix's last level."""
        for level, (ones, zero) in enumerate(zip(self.levels, self.zeros, strict=True)):
            r = ones[i]
            i = np.where((c >> (self.bits - 1 - level)) & 1, zero + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i ids of the transform are c."""
        return self._down(c, i) - self.origin[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [from, to) of each pattern, all of one length, by backward search."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        alive = np.arange(m)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            lo[alive] = self.starts[c] + self.rank(c, lo[alive])
            hi[alive] = self.starts[c] + self.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        out = np.zeros(m, bool)
        out[alive] = True
        return np.where(out, lo, 0), np.where(out, hi, 0)

    def _symbol(self, row: np.ndarray) -> np.ndarray:
        c = np.zeros(len(row), np.int64)
        for ones, zero in zip(self.levels, self.zeros, strict=True):
            r = ones[row]
            bit = ones[row + 1] - r
            c = (c << 1) | bit
            row = np.where(bit == 1, zero + r, row - r)
        return c

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps backward through the text to the nearest sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.flatnonzero(~self.is_sampled[rows])
        while len(left):
            c = self._symbol(rows[left])
            rows[left] = self.starts[c] + self.rank(c, rows[left])
            steps[left] += 1
            left = left[~self.is_sampled[rows[left]]]
        return self.positions[self.sampled[rows]] + steps
