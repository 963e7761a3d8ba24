"""Word shingles of whole texts as 64-bit hashes, and their MinHash values."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                  0xFF51AFD7ED558CCD], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Hashes of the sets of five-word shingles; remembers word hashes of up to ``memory`` words."""

    def __init__(self, memory: int = 300_000):
        self.memory = memory
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes.  Words are cut at white space and put in
        lower case; a text of one to four words is one shingle, a text
        without words has none."""
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > self.memory:
            self.known.clear()
        known, digest = self.known, xxhash.xxh3_64_intdigest
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        h = np.array(out, np.uint64)
        k = min(WORDS, len(h))
        n = len(h) - k + 1
        total = np.full(n, k, np.uint64)
        for j in range(k):
            total += h[j:j + n] * _MULT[j]
        return np.unique(_mixed(total))


class MinHash:
    """``n`` MinHash values (unsigned 32 bits) of a set of 64-bit hashes."""

    def __init__(self, n: int, seed: int = 20_240_601):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(1, 1 << 63, n, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(hashes), 4096):  # bounds the memory for very long texts
            values = (hashes[None, at:at + 4096] * self.a + self.b) >> np.uint64(32)
            np.minimum(out, values.min(axis=1).astype(np.uint32), out=out)
        return out
