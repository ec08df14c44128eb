"""Content-defined anchors of windows of symbols: bytes, or 64-bit hashes of words.

Every window of ``width`` symbols has one anchor: of its ``gram``-symbol substrings the one with the smallest
hash, the leftmost of equals. It depends on the window's symbols alone, so equal windows have equal
anchors at equal places. Windows of one anchor follow each other, and are handled as one run.
"""

from __future__ import annotations

import numpy as np

from .shingles import mixed

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i below n, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = out[0], out[1]
    return _powers


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram-symbol substring; one prefix sum serves them all."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    up, down = _powers_to(n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTES[data] if data.itemsize == 1 else data) * up[:n], out=s[1:])
    return mixed((s[gram:] - s[:-gram]) * down[: n - gram + 1])


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours, from minima toward the ends of blocks of w."""
    n = len(h)
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first window, number of windows, anchor, hash of the anchor, for each run of windows."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none.astype(np.uint64)
    h, w = gram_hashes(data, gram), width - gram + 1
    least = _window_minima(h, w)
    # A window's anchor changes where its minimum does, or where an equal one takes over.
    n = len(least)
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(change[1:], n)
    # Places of each minimum inside the windows of its stretch, in order.
    first, count, anchor = [], [], []
    for a, b, value in zip(change.tolist(), ends.tolist(), least[change].tolist(), strict=True):
        at = a + np.flatnonzero(h[a : b - 1 + w] == np.uint64(value))
        start = a
        for p in at.tolist():
            stop = min(b, p + 1)  # later windows don't hold it
            if stop > start:
                first.append(start)
                count.append(stop - start)
                anchor.append(p)
                start = stop
    anchor = np.array(anchor, np.int64)
    return np.array(first, np.int64), np.array(count, np.int64), anchor, h[anchor]
