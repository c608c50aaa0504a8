"""MinHash near-duplicate detection with circulant signatures.

Two permutations of the 32-bit integers, of different constants, make all signature coordinates: the first spreads the
shingles, the second is applied after a circular shift by k to give coordinate k. Bands of four coordinates name buckets. Documents that meet
in buckets form candidate groups (connected components over bucket heads, no pairs are made), and inside a candidate
group exact Jaccard is computed on the full shingle sets.

With 32 bands of 4 coordinates a pair at similarity 0.75 is missed with probability 5e-6. Documents with equal sets
are one class; only class representatives are compared. A candidate group is dealt out in blocks of bounded size: one
block is compared with each other block, what is linked then needs no further comparison, and only documents outside
the group's largest component are compared with all its blocks. So work is linear in a group that hangs together, no
block outgrows a task, and each comparison returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components
from .shingles import WordHashes, mix64, shingles

BANDS, ROWS = 32, 4
THRESHOLD = 75
#: Bounds of a block, of which a task holds two.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 19
_U32, _U64 = np.uint32, np.uint64


def _first(h: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers."""
    h = (h ^ (h >> _U32(16))) * _U32(0x85EBCA6B)
    h = (h ^ (h >> _U32(13))) * _U32(0xC2B2AE35)
    return h ^ (h >> _U32(16))


def _second(h: np.ndarray) -> np.ndarray:
    """Another one."""
    h = (h ^ (h >> _U32(16))) * _U32(0x7FEB352D)
    h = (h ^ (h >> _U32(15))) * _U32(0x846CA68B)
    return h ^ (h >> _U32(16))


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant signatures of non-empty sets: a row per set."""
    out = np.empty((len(sets), coordinates), _U32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 16):
            size += len(sets[end])
            end += 1
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        first = _first((np.concatenate(sets[at:end]) >> _U64(32)).astype(_U32))
        for k in range(coordinates):
            out[at:end, k] = np.minimum.reduceat(_second(first - _U32(k)), starts)
        at = end
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows).astype(_U64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U64), parts.shape[:2])
    for r in range(rows):
        key = mix64(key * _U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingles(t, hashes) for t in batch.column(1).to_pylist()]
        full = [s for s in sets if len(s)]
        keys = iter(band_keys(signatures(full)).tolist()) if full else iter(())
        rows = [(xxhash.xxh3_128_digest(s.tobytes()), next(keys)) if len(s) else (None, None) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "fp", "bands"],
        )


def forest(sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of the graph of all pairs with 100 * intersection >= threshold * union."""
    m = len(sets)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    del order
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    counts = np.diff(np.r_[starts, len(values)])
    del values, starts
    shared = np.repeat(counts > 1, counts)  # what only one set has is in no intersection
    owner, counts = owner[shared], counts[counts > 1]
    token = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    posting = np.r_[0, np.cumsum(counts)]
    by_doc = np.argsort(owner, kind="stable")
    tokens, bounds = token[by_doc], np.searchsorted(owner[by_doc], np.arange(m + 1))
    label, links, parts = np.arange(m), [], m
    for i in range(m):
        own = tokens[bounds[i] : bounds[i + 1]]
        if not len(own):
            continue
        lengths = counts[own]
        flat = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(posting[own], lengths)
        both = np.bincount(owner[flat], minlength=m)
        near = np.flatnonzero((100 * both >= threshold * (sizes[i] + sizes - both)) & (label != label[i]))
        for j in near.tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
                parts -= 1
        if parts == 1:
            break
    return links


def _link_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit: ``unit, rep, text``. Holds one unit at a time."""
    hashes, unit, reps, sets = WordHashes(), None, [], []

    def links() -> list[tuple[int, int]]:
        """A star for each component of the unit, around its smallest id."""
        label = np.arange(len(reps))
        for i, j in forest(sets):
            label[label == label[j]] = label[i]
        low: dict[int, int] = {}
        for r, l in zip(reps, label.tolist(), strict=True):
            low[l] = min(r, low.get(l, r))
        return [(r, low[l]) for r, l in zip(reps, label.tolist(), strict=True) if r != low[l]]

    def emit(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        found: list[tuple[int, int]] = []
        for u, rep, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if u != unit:
                found += links()
                unit, reps, sets = u, [], []
            reps.append(rep)
            sets.append(shingles(text, hashes))
        if found:
            yield emit(found)
    if found := links():
        yield emit(found)


def _links(units: DataFrame, texts: DataFrame) -> DataFrame:
    """``units``: unit (string), rep. One sorted pass over the units, each whole in one partition."""
    dealt = texts.join(units, "rep").repartition("unit").sortWithinPartitions("unit", "rep")
    return dealt.select("unit", "rep", "text").mapInArrow(_link_units, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked at 75 % Jaccard similarity of their distinct 5-word shingles (A-Z lower-cased); with fewer
    words the whole sequence is the one shingle. ``component_id`` is the smallest id reachable over links, itself
    included. A null, empty or blank text has no shingle and no link. Rows that repeat an id are one document. Rows
    without an id keep null as component and are kept. Ties fall to the smaller id. Texts of any length are
    shingled whole. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(source.mapInArrow(_sign, "doc_id long, n_shingles long, fp binary, bands array<long>"))
    classes = materialise(signed.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")))
    # Rows with one id but different texts are one document: their classes are linked through the id.
    same_id = signed.where("fp is not null and doc_id is not null").select("doc_id", "fp").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")

    banded = classes.select("rep", F.explode("bands").alias("key"))
    heads = materialise(banded.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("head")).where("c > 1").drop("c"))
    met = banded.join(heads, "key").where("rep <> head").select(F.col("rep").alias("u"), F.col("head").alias("v")).distinct()
    candidates = connected_components(met).withColumnsRenamed({"node": "rep", "component": "cand"})
    sized = candidates.join(classes.select("rep", "n"), "rep")
    groups = sized.groupBy("cand").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = materialise(sized.join(groups.select("cand", blocks.alias("blocks")), "cand").select("rep", "cand", "blocks", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block")).distinct())

    wanted = placed.select(F.col("rep").alias("doc_id"))
    texts = source.join(wanted, "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")
    if not signed.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["rep", "text"])
    texts = materialise(texts)
    against = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = placed.select("rep", "cand", F.explode(against).alias("j")).select("rep", F.concat_ws(":", "cand", "j").alias("unit"))
    # A group in one block is done: its links are stars around the smallest id of each component.
    links = materialise(_links(first, texts).join(placed.select(F.col("rep").alias("u"), "blocks"), "u"))
    found = links.where("blocks = 1").select(F.col("u").alias("rep"), F.col("v").alias("component"))
    links = links.where("blocks > 1").select("u", "v")

    several = not placed.where("blocks > 1").isEmpty()
    if several:
        large = placed.where("blocks > 1").join(connected_components(links).withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        large = materialise(large)
        counts = large.groupBy("cand", "component").agg(F.count("*").alias("c"))
        main = counts.groupBy("cand").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("docs"), F.max("c").alias("c"))
        rest = large.join(main.where("docs > c"), "cand").withColumn("rest_blocks", F.ceil((F.col("docs") - F.col("c")) / (BLOCK_DOCS // 2)).cast("int"))
        outside = F.col("component") != F.col("main")
        own = F.pmod(F.xxhash64("rep", F.lit(1)), "rest_blocks").cast("int")
        side = rest.where(outside).select("rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), own.alias("i"), "cand")
        every = rest.select("rep", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("i"), "cand")
        second = side.unionByName(every).distinct().select("rep", F.concat_ws(":", "cand", "i", "j").alias("unit"))
        links = links.unionByName(_links(second, texts))
    if not same_id.isEmpty():
        again = signed.where("fp is not null").join(same_id, "doc_id").join(classes.select("fp", "rep"), "fp")
        links = links.unionByName(again.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    if not same_id.isEmpty():
        found = connected_components(links.unionByName(found.select(F.col("rep").alias("u"), F.col("component").alias("v")))).withColumnsRenamed({"node": "rep"})
    elif several:
        found = found.unionByName(connected_components(links).withColumnsRenamed({"node": "rep"}))
    by_class = classes.select("fp", "rep").join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "fp").join(by_class, "fp", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document stands for its component, with all their columns.

    Rows without an id or without text stay, as do rows that repeat an id that stays. Columns may have any names.
    """
    dropped = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["__id"], "left_anti")
