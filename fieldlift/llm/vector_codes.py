"""Product quantisation in integers with memoised grid cells.

A component x becomes ``floor(1024 * x)``; vectors are cut into parts with a codebook each. To find the nearest entry of a part,
its coarse cell (components divided by ``cell``) is looked up in the task's cache. A cell's candidates are the entries that no
other one dominates over its box: those whose least distance to the box isn't above the smallest greatest distance. Only
these are evaluated exactly, so results don't depend on the cells. Cells are shared by near copies; in 16 dimensions few others share one,
and then the bounds of a cell are worked out for one vector.

A round is one pass over the written integer vectors. Tasks send sums by part and entry, at most ``parts * entries`` rows each,
and the same number of rows comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, stored

PARTS, ENTRIES, ROUNDS, CELL = 4, 256, 4, 32
#: Larger integers are taken as this: squared distances of whole vectors then fit 64 bits.
EDGE = 1 << 23
#: Cells that a task remembers by part, and cells whose bounds are worked out at once.
HELD_CELLS, BLOCK = 50_000, 256

Codebooks = list[np.ndarray]


class NearestByCell:
    """Nearest entries of one codebook, ties to the lower index."""

    def __init__(self, entries: np.ndarray, cell: int = CELL, limit: int = HELD_CELLS):
        self.entries, self.cell, self.limit = entries, cell, limit
        self.known: dict[bytes, np.ndarray] = {}

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        low = (cells * self.cell)[:, None, :]
        below, above = low - self.entries, self.entries - (low + self.cell - 1)
        least = np.square(np.maximum(np.maximum(below, above), 0)).sum(2)
        most = np.square(np.maximum(np.abs(below), np.abs(above))).sum(2)
        return [np.flatnonzero(x) for x in least <= most.min(1, keepdims=True)]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance for each row."""
        cells, inverse = np.unique(x // self.cell, axis=0, return_inverse=True)
        keys = [c.tobytes() for c in cells]
        if len(self.known) + len(keys) > self.limit:
            self.known.clear()
        new = [k for k, key in enumerate(keys) if key not in self.known]
        for at in range(0, len(new), BLOCK):
            block = new[at : at + BLOCK]
            self.known.update(zip([keys[k] for k in block], self._candidates(cells[block]), strict=True))
        lists = [self.known[k] for k in keys]
        sizes = np.array([len(c) for c in lists])
        begin = np.cumsum(sizes) - sizes
        inverse = inverse.reshape(-1)
        n = sizes[inverse]
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(len(x)), n)
        entry = np.concatenate(lists)[np.repeat(begin[inverse] - first, n) + np.arange(n.sum())]
        d = np.square(x[row] - self.entries[entry]).sum(1)
        best = np.minimum.reduceat(d, first)
        hit = np.flatnonzero(d == best[row])
        _, where = np.unique(row[hit], return_index=True)  # candidates ascend, so the first is the lowest
        return entry[hit[where]], best


def widths(dimension: int, parts: int) -> list[int]:
    """Lengths of the parts; where they can't be equal the first ones have a component more."""
    return [dimension // parts + (k < dimension % parts) for k in range(parts)]


def _parts(batch: pa.RecordBatch, size: list[int]) -> list[np.ndarray]:
    x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, sum(size))
    return np.split(x, np.cumsum(size)[:-1], axis=1)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, x`` of the rows whose vector isn't null or empty and holds finite components only; written once."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * 1024, F.lit(float(EDGE))), F.lit(-float(EDGE)))).cast("int"))
    return stored(vectors.where(v.isNotNull() & (F.size(v) > 0) & finite).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole.alias("x")))


def _sums(codebooks: Codebooks, size: list[int], cell: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [NearestByCell(c, cell) for c in codebooks]
        n = [np.zeros(len(c), np.int64) for c in codebooks]
        total = [np.zeros((len(c), max(size)), np.int64) for c in codebooks]
        for batch in batches:
            if not batch.num_rows:
                continue
            for k, x in enumerate(_parts(batch, size)):
                entry, _ = near[k](x)
                n[k] += np.bincount(entry, minlength=len(n[k]))
                order = np.argsort(entry, kind="stable")
                found, at = np.unique(entry[order], return_index=True)
                total[k][found, : x.shape[1]] += np.add.reduceat(x[order], at)
        part = np.repeat(np.arange(len(n)), [len(x) for x in n])
        entry = np.concatenate([np.arange(len(x)) for x in n])
        count, sums = np.concatenate(n), np.concatenate(total)
        on = count > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[on]) for c in (part, entry, count, *sums.T)], names=["part", "entry", "n", *[f"s{j}" for j in range(max(size))]])

    return rows_of


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL) -> Codebooks:
    """Codebooks of the rows of ``integers``: those of the smallest ids (ties by components, nulls last), then rounds of means, floored.

    The first vector's length holds: vectors of other lengths have no part in the fit. An entry that no part chose stays. Without rows: none.
    """
    start = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()  # at most ``entries`` rows
    if not start:
        return []
    size = widths(len(start[0]["x"]), parts)
    first = np.array([r["x"] for r in start if len(r["x"]) == sum(size)], np.int64)
    codebooks = [np.ascontiguousarray(c) for c in np.split(first, np.cumsum(size)[:-1], axis=1)]
    same = rows.where(F.size("x") == sum(size))
    names = [f"s{j}" for j in range(max(size))]
    for _ in range(rounds):
        sent = same.mapInArrow(_sums(codebooks, size, cell), f"part long, entry long, n long, {', '.join(f'{c} long' for c in names)}")
        for r in sent.groupBy("part", "entry").agg(F.sum("n"), *[F.sum(c) for c in names]).collect():  # at most parts * entries rows
            k = r[0]
            codebooks[k][r[1]] = [s // r[2] for s in r[3 : 3 + size[k]]]
    return codebooks


def encode(rows: DataFrame, codebooks: Codebooks, cell: int = CELL) -> DataFrame:
    """``vec_id, label, code, error``: indices of the nearest entries in hex, and the squared distance; vectors of other lengths are left out."""
    size = [c.shape[1] for c in codebooks]
    digits = max(2, *(len(f"{len(c) - 1:x}") for c in codebooks)) if codebooks else 2

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [NearestByCell(c, cell) for c in codebooks]
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [near[k](x) for k, x in enumerate(_parts(batch, size))]
            code = ["".join(f"{e:0{digits}x}" for e in row) for row in zip(*(f[0].tolist() for f in found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.where(F.size("x") == sum(size)).mapInArrow(rows_of, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def codebooks_digest(codebooks: Codebooks) -> str:
    """SHA-256 of all entries' components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for c in codebooks for v in c.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each vector of finite components.

    ``label_error`` is the sum over rows of the same label, nulls together; null if it passes 64 bits. Rows without an id
    stay, repeated rows count each. Null and empty vectors and those of another length than the first one's go; components
    beyond 8192 count as 8192. Other columns aren't read. No vectors: no rows.
    """
    rows = integers(vectors, id_col, vector_col, label_col)
    codebooks = fit(rows, parts, entries, rounds, cell)
    if not codebooks:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(codebooks_digest([])).alias("codebooks_sha256"))
    coded = stored(encode(rows, codebooks, cell)).withColumn("none", F.col("label").isNull()).withColumn("key", F.coalesce(F.col("label").cast("string"), F.lit("")))
    by_label = coded.groupBy("none", "key").agg(F.try_sum("error").alias("label_error"))
    out = join_small(coded, by_label, ["none", "key"], by_label.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
