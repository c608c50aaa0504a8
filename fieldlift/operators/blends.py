"""The blend of two rankings under a bootstrap of accounts.

Draws are vectors: an account's row carries its rank in every draw as an array, and all weights are tried on these arrays in
numpy. What leaves a task is sums by (weight, block of the order, draw), and the few accounts of the blocks in which lists end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import materialise
from . import draws as D
from . import ranks, resample

GUARDRAIL = 0.90
#: Distinct values whose counts are cumulated in one group, and numbers (rows times draws) that a task holds at once.
LEVELS, AT_ONCE = 1024, 500_000


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, AT_ONCE // width)
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def drawn_ranks(rows: DataFrame, column: str, reps: int) -> DataFrame:
    """``rows`` with ``r<column>``: twice the average rank among the drawn rows, by draw; ties count half, copies count.

    Equal values are one level. Counts are added up by level and draw, cumulated inside groups of ``LEVELS`` levels, and the
    groups before are added: nothing is sorted by draw.
    """
    draw = np.arange(reps + 1)
    levels = ranks.global_scan(rows.select(column).distinct(), [F.col(column)], rank="level").select(F.col(column).alias("__v"), F.floor((F.col("level") - 1) / LEVELS).alias("part"), "level")
    placed = materialise(rows.join(levels, rows[column].eqNullSafe(F.col("__v"))).drop("__v"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches, len(draw)):
            level, code = np.unique(b.column("level").to_numpy(), return_inverse=True)
            m = np.zeros((len(level), len(draw)), np.int64)
            np.add.at(m, code, D.poisson_one(b.column("h").to_numpy(), draw))
            yield pa.RecordBatch.from_arrays([pa.array((level - 1) // LEVELS), pa.array(level), pa.array(list(m), pa.list_(pa.int64()))], names=["part", "level", "m"])

    partial = materialise(placed.select("level", "h").mapInArrow(counts, "part long, level long, m array<long>"))
    totals = partial.select("part", F.posexplode("m").alias("rep", "m")).groupBy("part", "rep").agg(F.sum("m").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = totals.withColumn("before", before).groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("rep", "before"))), lambda x: x["before"]).alias("before"))

    def ranked(found: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        level, code = np.unique(found["level"].to_numpy(), return_inverse=True)
        m = np.zeros((len(level), len(draw)), np.int64)
        np.add.at(m, code, np.stack(found["m"].to_numpy()))
        below = np.cumsum(m, 0) - m + np.asarray(start["before"].iloc[0])
        return pd.DataFrame({"level": level, "rank": list(2 * below + m + 1)})

    by_level = partial.groupBy("part").cogroup(ahead.groupBy("part")).applyInPandas(ranked, "level long, rank array<long>")
    return placed.join(by_level.withColumnRenamed("rank", f"r{column}"), "level").drop("level", "part")


def bootstrap_frontier(panel: DataFrame, k: int, weights: Sequence[float], *, reps: int = 200, floor: float = GUARDRAIL, seed: int = 7, blocks: int = 200) -> DataFrame:
    """By weight: intervals of both captures' ratios to volume alone, and how often the absolute one clears the floor.

    In each draw opportunity and volume are ranked anew among the drawn accounts, and each weight has a list of its first
    ``k`` drawn accounts, copies counted, ties by key. Weights that aren't 0 need that of 0 beside them.
    """
    pos = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    draw, count = np.arange(reps + 1), len(weights)
    rows = materialise(panel.select("npi", F.col("opportunity").cast("double").alias("o"), F.col("class_fills").cast("double").alias("v"), pos("growth_abs").cast("double").alias("ga"), pos("growth_share").cast("double").alias("gs"), F.xxhash64("npi", F.lit(seed)).alias("h")))
    placed = materialise(drawn_ranks(drawn_ranks(rows, "o", reps), "v", reps).select("npi", "h", "ga", "gs", "ro", "rv"))
    spark = panel.sparkSession

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(draw), np.int64)
        for b in _chunks(batches, len(draw)):
            out += D.poisson_one(b.column("h").to_numpy(), draw).sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(draw), pa.array(out)], names=["rep", "n"])

    every = placed.select("h").mapInArrow(totals, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).collect()  # a row per draw
    size = np.zeros(len(draw))
    for r in every:
        size[r["rep"]] = r["n"]

    def orders(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each weight the order of the rows by draw (lowest first), and its block."""
        matrix = lambda c: np.stack(b.column(c).to_numpy(zero_copy_only=False)) / (2 * np.maximum(size, 1))
        ro, rv = matrix("ro"), matrix("rv")
        for j, w in enumerate(weights):
            order = np.round(-(w * ro + (1 - w) * rv), 12)
            yield j, order, np.clip(np.floor(order * blocks).astype(np.int64) + 2 * blocks, 0, 2 * blocks - 1)

    shape = (2 * blocks, 3, len(draw))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in _chunks(batches, len(draw)):
            m = D.poisson_one(b.column("h").to_numpy(), draw).astype(float)
            parts = [m, m * b.column("ga").to_numpy()[:, None], m * b.column("gs").to_numpy()[:, None]]
            for j, _, at in orders(b):
                key = (at * len(draw) + draw).ravel()
                got = np.stack([np.bincount(key, p.ravel(), shape[0] * shape[2]).reshape(shape[0], shape[2]) for p in parts], 1)
                held[j] = held[j] + got if j in held else got
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["j", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By weight: the block in which each draw's list ends (-1: it takes all), the rows before it, and gains of whole blocks and of all."""
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for j, x in zip(b.column("j").to_pylist(), b.column("sums").to_pylist(), strict=True):
                part = np.frombuffer(x).reshape(shape)
                total[j] = total[j] + part if j in total else part
        out: list[list] = []
        for j, t in total.items():
            upto = np.cumsum(t[:, 0], 0)
            whole = upto <= k
            cut = (upto - t[:, 0] < k) & ~whole
            last = np.where(cut.any(0), cut.argmax(0), -1)
            ahead = np.where(last >= 0, (upto - t[:, 0])[np.maximum(last, 0), draw], 0)
            out.append([j, last.tolist(), ahead.tolist(), *[(t[:, g] * whole).sum(0).tolist() for g in (1, 2)], *[t[:, g].sum(0).tolist() for g in (1, 2)]])
        cols = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.int64())), *[pa.array(c, pa.list_(pa.float64())) for c in cols[2:]]], names=["j", "last", "ahead", "wa", "ws", "ta", "ts"])

    ends = placed.mapInArrow(sums, "j int, sums binary").repartition(count, "j").mapInArrow(added, "j int, last array<long>, ahead array<double>, wa array<double>, ws array<double>, ta array<double>, ts array<double>").collect()  # a row per weight
    by = {r["j"]: r for r in ends}
    last = {j: np.array(r["last"]) for j, r in by.items()}

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drawn rows of the blocks in which lists end."""
        for b in _chunks(batches, len(draw)):
            m = D.poisson_one(b.column("h").to_numpy(), draw)
            found = []
            for j, order, at in orders(b):
                i, r = np.nonzero((at == last[j]) & (m > 0))
                found.append((i, np.full(len(i), j), r, order[i, r], m[i, r]))
            i, j, r, order, copies = (np.concatenate(c) for c in zip(*found, strict=True))
            take = lambda c: b.column(c).take(pa.array(i))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(r.astype(np.int32)), pa.array(order), take("npi"), pa.array(copies.astype(np.int64)), take("ga"), take("gs")], names=["j", "rep", "order", "npi", "m", "ga", "gs"])

    known = [(j, int(r), int(x["ahead"][r]), *[float(x[c][r]) for c in ("wa", "ws", "ta", "ts")]) for j, x in by.items() for r in draw]
    facts = spark.createDataFrame(known, "j int, rep int, ahead long, wa double, ws double, ta double, ts double")  # a row per weight and draw
    prior = F.col("ahead") + F.coalesce(F.sum("m").over(Window.partitionBy("j", "rep").orderBy("order", "npi").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = placed.mapInArrow(tails, f"j int, rep int, order double, npi {dict(placed.dtypes)['npi']}, m long, ga double, gs double").join(facts.select("j", "rep", "ahead"), ["j", "rep"])
    part = end.withColumn("take", F.greatest(F.least(F.col("m"), k - prior), F.lit(0))).groupBy("j", "rep").agg(F.sum(F.col("take") * F.col("ga")).alias("ca"), F.sum(F.col("take") * F.col("gs")).alias("cs"))
    per = facts.join(part, ["j", "rep"], "left").withColumn("lga", F.col("wa") + F.coalesce("ca", F.lit(0.0))).withColumn("lgs", F.col("ws") + F.coalesce("cs", F.lit(0.0)))
    per = materialise(per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("j") + 1)).select("weight", "rep", "lga", "lgs"))
    base = per.where("weight = 0").select("rep", F.col("lga").alias("a0"), F.col("lgs").alias("s0"))
    long = per.join(base, "rep", "left").withColumn("abs_ratio", F.try_divide("lga", "a0")).withColumn("share_ratio", F.try_divide("lgs", "s0"))
    clears = F.avg(F.when(F.col("rep") > 0, (F.col("abs_ratio") >= floor).cast("double")))
    return long.groupBy("weight").agg(*resample.interval("abs_ratio"), *resample.interval("share_ratio"), F.round(clears, 2).alias("p_clears_floor"))


def robust_weight(frontier: DataFrame, sure: float = 0.95) -> DataFrame:
    """The weight of the highest share ratio among those that clear the floor in at least ``sure`` of the draws; volume alone if none does."""
    best = frontier.where(F.col("p_clears_floor") >= sure).agg(F.max(F.struct("share_ratio", -F.col("weight"))).alias("b"))
    return best.select(F.coalesce(-F.col("b.col2"), F.lit(0.0)).alias("weight"))
