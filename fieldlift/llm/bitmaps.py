"""Maps of hashed keys with a fixed number of bits, made in Spark and sent to all tasks.

Keys share bits, so a map lets keys pass that weren't put in, never the other way round: it saves rows and decides nothing. With
more keys than bits it lets everything pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix64

_U = np.uint64


def bitmap(hashes: DataFrame, power: int) -> np.ndarray:
    """``2 ** power`` bits with those of the long column ``h`` set; at most ``2 ** (power - 6)`` rows come to the driver, as Arrow."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array((mix64(b.column("h").to_numpy().view(_U)) >> _U(64 - power)).astype(np.int64))], names=["at"])

    words = hashes.mapInArrow(places, "at long").groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v")).toArrow()
    out = np.zeros(1 << (power - 6), _U)
    out[words["w"].to_numpy()] = words["v"].to_numpy().view(_U)
    return out


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = mix64(h) >> _U(64 - (len(bits).bit_length() - 1 + 6))
    return (bits[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
