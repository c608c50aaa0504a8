"""Hashed text features and sparse linear algebra for the small models; numpy inside Spark tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import xxhash

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?%$&*#|\"'()[]{}<>-_"
DIMENSIONS = 1 << 18


class HashedFeatures(dict):
    """Word to the hashed indices of its features (of those in ``used``), remembered for ``limit`` distinct words at most."""

    def __init__(self, names: Callable[[str], list[str]], dimensions: int = DIMENSIONS, limit: int = 100_000, used: np.ndarray | None = None):
        super().__init__()
        self.names, self.dimensions, self.limit = names, dimensions, limit
        self.used = None if used is None else set(used.tolist())

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = (xxhash.xxh32_intdigest(n) % self.dimensions for n in self.names(word))
        value = self[word] = tuple(found if self.used is None else (i for i in found if i in self.used))
        return value

    def of(self, text: str | None, extra: Iterable[str] = ()) -> np.ndarray:
        """Sorted distinct feature indices of a whole text, and of ``extra`` features, which no word can spell."""
        found = set().union(*map(self.__getitem__, set(TOKEN.findall(text or ""))))
        found.update(xxhash.xxh32_intdigest(e, seed=1) % self.dimensions for e in extra)
        return np.array(sorted(found), np.int32)


class Rows:
    """Binary sparse rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.columns = np.concatenate(rows).astype(np.int32, copy=False) if rows else np.empty(0, np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.columns], self.n)

    def back(self, values: np.ndarray, dimensions: int) -> np.ndarray:
        return np.bincount(self.columns, values[self.row], dimensions)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
