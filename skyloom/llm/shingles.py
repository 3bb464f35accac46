"""Hashed word shingles of whole texts, as numpy arrays.

A text is lower-cased over A-Z, split into words at ASCII white space and cut
into overlapping shingles of ``size`` words.  A text with fewer words than
``size`` has its whole word sequence as its only shingle; a text without words
(or null) has none.  Equal shingles get equal 64-bit hashes on every machine.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads nearby values over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of a word, kept while the table is small enough."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Shingler:
    """Distinct sorted shingle hashes of a text."""

    def __init__(self, size: int):
        self.size = size
        self.words = WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        table = self.words
        h = np.fromiter((table[w] for w in words), np.uint64, len(words))
        k = min(self.size, len(h))
        total = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):  # order matters: each place has its own multiplier
            total = mix(total + h[i : len(h) - k + 1 + i] + np.uint64((_STEP * (i + 1)) % 2**64))
        return np.unique(total ^ np.uint64(k))
