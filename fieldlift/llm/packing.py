"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of tokens.

Documents are dealt to shards of bounded size, in tokens and in rows, by a hash of id, text and copy; each shard is packed
on its own, largest first. The
shard's open bins are kept in order of their residual. For an item the search starts at the smallest residual that
holds it and goes on to the next larger one until a bin is compatible: one without a document of the same duplicate
cluster and, for sources of a small token share, without another document of that source. Both are bitmaps of the bin.
Longer documents are cut: their full pieces fill bins of their own, the last piece is packed. A document without tokens
conflicts with nothing.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_small, materialise, word_count

CAPACITY = 2048
#: Bins and documents of a shard, about.
SHARD_BINS, SHARD_ROWS = 512, 8192
#: A source below this share of all tokens may be in a bin once.
ONCE_BELOW = 0.08


def best_fit(sizes: list[int], clusters: list[int], once: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in the order given. Clusters and ``once`` sources are bit numbers, or -1 for none."""
    residuals: list[tuple[int, int]] = []  # (residual, bin), ascending
    cluster_bits: list[int] = []
    source_bits: list[int] = []
    bins, offsets = [], []
    for size, cluster, source in zip(sizes, clusters, once, strict=True):
        c, s = (1 << cluster if cluster >= 0 else 0), (1 << source if source >= 0 else 0)
        at = bisect.bisect_left(residuals, (size, -1))
        while at < len(residuals) and (cluster_bits[residuals[at][1]] & c or source_bits[residuals[at][1]] & s):
            at += 1
        if at < len(residuals):
            room, b = residuals.pop(at)
        else:
            room, b = capacity, len(cluster_bits)
            cluster_bits.append(0)
            source_bits.append(0)
        cluster_bits[b] |= c
        source_bits[b] |= s
        bins.append(b)
        offsets.append(capacity - room)
        bisect.insort(residuals, (room - size, b))
    return bins, offsets


def _pack_shard(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack_shard(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["size", "doc_id", "cluster", "source", "n_tokens"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        # Clusters with one member here can't conflict: they get no bit.
        repeated = items["cluster"].duplicated(keep=False) & (items["size"] > 0)
        clusters = pd.factorize(items["cluster"].where(repeated))[0].tolist()
        once = np.where(items["once"] & (items["size"] > 0), pd.factorize(items["source"], use_na_sentinel=False)[0], -1).tolist()
        bins, offsets = best_fit(items["size"].tolist(), clusters, once, capacity)
        last = items.assign(length=items["size"], bin=bins, offset=offsets)
        # Full pieces have the bins behind those, in the same order.
        pieces = (items["start"] // capacity).to_numpy()
        whole = items.loc[np.repeat(items.index.to_numpy(), pieces)]
        place = np.arange(len(whole)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = whole.assign(start=place * capacity, length=capacity, bin=max(bins) + 1 + np.arange(len(whole)), offset=0)
        return pd.concat([last, whole])[["shard", "doc_id", "source", "n_tokens", "start", "length", "bin", "offset"]]

    return pack_shard


def pack(docs: DataFrame, capacity: int = CAPACITY, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, once_below: float = ONCE_BELOW, shard_bins: int = SHARD_BINS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: ``doc_id, source, n_tokens, start, length, bin_id, bin_offset``.

    Tokens are words. ``start`` and ``length`` are the piece's tokens in its document, ``bin_offset`` where it begins in
    its sequence. ``cluster`` names duplicate clusters (a long; as a default equal texts without white space are one).
    A document without tokens is one piece of length 0, in the fullest bin. Repeated rows are separate documents of one
    cluster, so they never share a bin. Null ids and sources are allowed; a null source is one source. Bin ids depend on
    the rows alone. An empty table gives an empty result. Other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.xxhash64(F.regexp_replace(text, f"{SPACE}+", "")) if cluster is None else cluster
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster"), word_count(F.col(text_col)).alias("n_tokens"))
    narrow = materialise(narrow.groupBy("doc_id", "source", "cluster", "n_tokens").agg(F.count("*").alias("copies")))
    shares = materialise(narrow.groupBy(F.coalesce("source", F.lit("\0null")).alias("s")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.sum("copies").alias("docs")))
    total, rows, n_sources = shares.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total // (capacity * shard_bins)), -(-rows // shard_rows))
    items = join_small(narrow.withColumn("s", F.coalesce("source", F.lit("\0null"))), shares.select("s", (F.col("t") < once_below * total).alias("once")), ["s"], n_sources).drop("s")

    full = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / capacity).cast("long")
    items = items.withColumn("start", full * capacity).withColumn("size", F.col("n_tokens") - full * capacity)
    items = items.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(shards)).cast("int")).drop("copy")
    schema = "shard int, doc_id long, source string, n_tokens long, start long, length long, bin long, offset long"
    packed = items.groupBy("shard").applyInPandas(_pack_shard(capacity), schema)
    return packed.select("doc_id", "source", "n_tokens", "start", "length", (F.col("shard") * F.lit(1 << 32) + F.col("bin")).alias("bin_id"), F.col("offset").alias("bin_offset"))
