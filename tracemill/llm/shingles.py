"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z become a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Word hashes are cached, up to a bound."""

    def __init__(self, width: int = 5, cache: int = 150_000):
        self.width, self.most, self.known = width, cache, {}

    def _hash(self, word: bytes) -> int:
        if len(self.known) >= self.most:
            self.known.clear()
        h = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def ordered(self, text: str | None) -> np.ndarray:
        """A hash for each shingle, in text order."""
        words, k = words_of(text), self.width
        if not words:
            return np.zeros(0, np.uint64)
        get, known = self._hash, self.known
        h = np.array([known.get(w) or get(w) for w in words], np.uint64)
        if len(h) < k:
            return mixed(np.array([(h * _POWERS[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            out += h[j : len(h) - k + 1 + j] * _POWERS[j]
        return mixed(out)

    def set_of(self, text: str | None) -> np.ndarray:
        return np.unique(self.ordered(text))
