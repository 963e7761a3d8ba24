"""Hashed character n-grams of words, for many words at once."""

from __future__ import annotations

import numpy as np

_OPEN, _SHUT = 0x2, 0x3  # marks for the two ends of a word: n-grams that hold one are affixes


def ngram_features(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, owners): bucket numbers of all n-grams and of each whole word, and the words they belong to.

    Owners ascend, and every word has at least one feature.
    """
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters to the word's end
    features, owners = [], []
    for n in sizes:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        inside = left[:count] >= n
        features.append(h[inside])
        owners.append(owner[:count][inside])
    # the whole word: a sum over its characters that depends on their places
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    term = (codes + np.uint64(0x51)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(0xD6E8FEB86659FD93))
    term ^= term >> np.uint64(32)
    term *= np.uint64(0xC2B2AE3D27D4EB4F)
    starts = np.cumsum(lengths) - lengths
    features.append(np.add.reduceat(term, starts) if len(words) else np.empty(0, np.uint64))
    owners.append(np.arange(len(words)))
    features, owners = np.concatenate(features), np.concatenate(owners)
    features ^= features >> np.uint64(29)
    order = np.argsort(owners, kind="stable")
    return (features[order] % np.uint64(buckets)).astype(np.int64), owners[order]


def summed(weights: np.ndarray, features: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Sum of the weight rows of each word's features."""
    if not n:
        return np.zeros((0, weights.shape[1]), weights.dtype)
    return np.add.reduceat(weights[features], np.searchsorted(owners, np.arange(n)), axis=0)
