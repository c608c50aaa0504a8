"""Word shingles of whole texts as sorted arrays of 64-bit hashes; small numpy helpers used inside Spark tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
#: Lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixer of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Word to 64-bit hash, remembered for the most recent ``limit`` distinct words at most."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of the whole sequence if it is shorter; empty without words."""
    words = WORD_BYTES.findall(text.encode().translate(LOWER)) if text else []
    if not words:
        return np.empty(0, _U)
    ids = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    n = min(width, len(words))
    h = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        h = h * _STEP + ids[k : len(ids) - n + 1 + k]
    return np.unique(mix64(h + _U(n)))
