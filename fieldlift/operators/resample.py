"""Bootstraps and permutation tests with hashed draws, so that results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import materialise
from . import draws as D
from . import ranks, stats

#: Counts (rows times draws) that a task makes at once, and blocks that it holds.
AT_ONCE, HELD_BLOCKS = 2_000_000, 500


def drawn(rows: DataFrame, reps: int, seed: int, key: str = "npi") -> DataFrame:
    """Rows once more for each draw ``rep`` with their Poisson(1) count ``m``, if it isn't 0; draw 0 is the table itself."""
    w = F.when(F.col("rep") == 0, F.lit(1)).otherwise(stats.poisson_weight(F.xxhash64(key, "rep", F.lit(seed))))
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).withColumn("m", w).where("m > 0")


def interval(c: str, name: str | None = None, *, se: bool = False) -> list[Column]:
    """Estimate (draw 0), percentile interval and, with ``se``, the standard error over draws of a column."""
    over, name = F.when(F.col("rep") > 0, F.col(c)), name or c
    out = [F.max(F.when(F.col("rep") == 0, F.col(c))).alias(name), F.percentile(over, 0.025).alias(f"{name}_low"), F.percentile(over, 0.975).alias(f"{name}_high")]
    return [*out, F.stddev_samp(over).alias(f"{name}_se")] if se else out


def shuffled(rows: DataFrame, value: str, reps: int, seed: int, key: str = "npi", stratum: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """``rep, key``, the columns in ``carry`` and ``value``: in each shuffle the value of another row of the same stratum; draw 0 is the table itself.

    Rows are numbered once, in the order of strata and keys. A shuffle is a keyed permutation of the numbers of a stratum, so the number of a row's
    donor is computed, and the only shuffle of ``reps`` times the rows is the join on that number.
    """
    s = F.col(stratum) if stratum else F.lit(0)
    own = ranks.global_scan(rows.select(key, value, *[c for c in carry if c not in (key, value)], s.alias("__s")), [F.col("__s"), F.col(key)], rank="__i")
    strata = own.groupBy(F.col("__s").alias("__t")).agg((F.min("__i") - 1).alias("__start"), F.count("*").alias("__n"))
    own = materialise(own.join(strata, F.col("__s").eqNullSafe(F.col("__t"))).drop("__s", "__t"))
    kept = [key, *carry]

    def donors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.arange(1, reps + 1)
        step = max(1, AT_ONCE // max(reps, 1))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                i, start, n = (b.column(c).to_numpy() for c in ("__i", "__start", "__n"))
                # A stratum has permutations of its own: its start tells it from others of the same size.
                to = start[:, None] + 1 + D.permuted((i - 1 - start)[:, None], n[:, None], draw[None, :] + (start[:, None] << 20), seed)
                row = np.repeat(np.arange(b.num_rows), reps)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(draw, b.num_rows).astype(np.int32)), pa.array(to.ravel()), *[b.column(c).take(pa.array(row)) for c in kept]], names=["rep", "__donor", *kept])

    kinds = dict(own.dtypes)
    asks = own.mapInArrow(donors, ", ".join(["rep int", "__donor bigint", *[f"`{c}` {kinds[c]}" for c in kept]]))
    given = own.select(F.col("__i").alias("__donor"), F.col(value).alias("__value"))
    dealt = asks.join(given, "__donor").select("rep", *kept, F.col("__value").alias(value))
    return own.select(F.lit(0).alias("rep"), *kept, value).unionByName(dealt)


def _block_sums(gains: list[str], reps: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drawn rows and their gains by (rule, block, draw): a task adds up vectors over draws, and its rows are never repeated."""
    draw = np.arange(reps + 1)
    names = ["bm", *[f"t{g}" for g in gains]]

    def passed(held: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
        rules = [r for r, _ in held for _ in draw]
        blocks = np.repeat(np.array([k for _, k in held], np.int64), len(draw))
        sums = np.concatenate(list(held.values()), axis=1) if held else np.empty((len(names), 0))
        return pa.RecordBatch.from_arrays([pa.array(rules, pa.string()), pa.array(blocks), pa.array(np.tile(draw, len(held)).astype(np.int32)), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])], names=["rule", "block", "rep", *names])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        step = max(1, AT_ONCE // len(draw))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                m = D.poisson_one(b.column("h").to_numpy(), draw).astype(float)
                value = np.stack([np.ones(b.num_rows), *[b.column(g).to_numpy() for g in gains]])
                places = pd.MultiIndex.from_arrays([b.column("rule").to_pandas(), b.column("block").to_numpy()])
                code, found = pd.factorize(places)
                for k, place in enumerate(found):
                    mine = code == k
                    sums = value[:, mine] @ m[mine]
                    held[place] = held[place] + sums if place in held else sums
            if len(held) > HELD_BLOCKS:
                yield passed(held)
                held = {}
        yield passed(held)

    return rows_of


def capture_totals(ranked: DataFrame, k: int, gains: list[str], reps: int) -> DataFrame:
    """``rep, rule`` with sums over all drawn rows (``t<gain>``) and over the first ``k`` of them, copies counted (``l<gain>``).

    ``ranked``: rule, block, rn, the hash ``h`` of the key, and the gains. Counts are summed by block; then the rows of the
    blocks in which ``k`` ends are counted one after another. A block has a bounded number of rows.
    """
    types = ", ".join(f"t{g} double" for g in gains)
    blocks = materialise(ranked.mapInArrow(_block_sums(gains, reps), f"rule string, block long, rep int, bm long, {types}").groupBy("rule", "block", "rep").agg(F.sum("bm").alias("bm"), *[F.sum(f"t{g}").alias(f"t{g}") for g in gains]))
    ahead = F.coalesce(F.sum("bm").over(Window.partitionBy("rule", "rep").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("ahead", ahead)
    whole = placed.groupBy("rep", "rule").agg(*[F.sum(F.when(F.col("ahead") + F.col("bm") <= k, F.col(f"t{g}"))).alias(f"w{g}") for g in gains], *[F.sum(f"t{g}").alias(f"t{g}") for g in gains])
    last = materialise(placed.where((F.col("ahead") < k) & (F.col("ahead") + F.col("bm") > k)).groupBy("rule", "block").agg(F.sort_array(F.collect_list(F.struct("rep", "ahead"))).alias("ends")))

    def cut(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        """What the lists that end in this block take of it."""
        if ends.empty or rows.empty:
            return pd.DataFrame({"rep": [], "rule": [], **{f"c{g}": [] for g in gains}})
        rows = rows.sort_values("rn")
        rep = np.array([e["rep"] for e in ends["ends"].iloc[0]])
        room = k - np.array([e["ahead"] for e in ends["ends"].iloc[0]])
        m = D.poisson_one(rows["h"].to_numpy(), rep).astype(np.int64)
        take = np.clip(room[None, :] - (np.cumsum(m, 0) - m), 0, m)
        return pd.DataFrame({"rep": rep, "rule": rows["rule"].iloc[0], **{f"c{g}": rows[g].to_numpy() @ take for g in gains}})

    inside = ranked.join(last.select("rule", "block"), ["rule", "block"], "left_semi")
    part = inside.groupBy("rule", "block").cogroup(last.groupBy("rule", "block")).applyInPandas(cut, "rep int, rule string, " + ", ".join(f"c{g} double" for g in gains))
    out = whole.join(part, ["rep", "rule"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return materialise(out.select("rep", "rule", *[(zero(f"w{g}") + zero(f"c{g}")).alias(f"l{g}") for g in gains], *[f"t{g}" for g in gains]))


def bootstrap_capture(panel: DataFrame, rules: Mapping[str, str], value: str, k: int, reps: int = 400, seed: int = 5, baseline: str = "volume", share: str | None = None, block: int = 10_000) -> DataFrame:
    """Capture of each rule's list and its ratio to the baseline's, with percentile intervals; with ``share`` the same of a second column.

    Accounts are drawn with Poisson(1) counts from a hash of key and draw, and each draw has lists of its own: its first
    ``k`` drawn accounts, copies counted, in the order of the score. That order is the same in all draws, so rows are
    numbered once by rule; draws are vectors in ``capture_totals``, so a row is never repeated by draw.
    """
    values = {"": value} | ({"share_": share} if share else {})
    gains = {f"g{p}": F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) for p, c in values.items()}
    ranked = stats.union_all([ranks.global_scan(panel.select("npi", F.col(c).cast("double").alias("score"), *[x.alias(g) for g, x in gains.items()]), [F.col("score").desc_nulls_last(), F.col("npi")]).select("npi", F.lit(r).alias("rule"), "rn", *gains) for r, c in rules.items()])
    per = capture_totals(ranked.select("rule", F.floor((F.col("rn") - 1) / block).alias("block"), "rn", F.xxhash64("npi", F.lit(seed)).alias("h"), *gains), k, list(gains), reps)
    long = per.join(per.where(F.col("rule") == baseline).select("rep", *[F.col(f"l{g}").alias(f"b{g}") for g in gains]), "rep", "left")
    long = long.withColumns({f"{p}{c}": F.try_divide(f"lg{p}", f"{d}g{p}") for p in values for c, d in (("capture", "t"), ("ratio", "b"))})
    out = long.groupBy("rule").agg(*[x for p in values for c in (f"{p}capture", f"{p}ratio") for x in interval(c, se=True)])
    return out.withColumns({f"{p}excludes_one": (F.col(f"{p}ratio_low") > 1) | (F.col(f"{p}ratio_high") < 1) for p in values})


def permutation_test(df: DataFrame, stratum: str, x: str, y: str, key: str = "npi", reps: int = 200, seed: int = 9) -> DataFrame:
    """Slope of y on x against slopes after shuffling x inside strata: the share of shuffles at least as steep.

    No stratum has to fit a task.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(stratum).alias("s"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    slopes = materialise(shuffled(rows, "x", reps, seed, key, "s", ["y"]).groupBy("rep").agg(F.regr_slope("y", "x").alias("b")))  # a row per shuffle
    real = slopes.where("rep = 0").select(F.col("b").alias("slope"))
    return slopes.where("rep > 0").join(F.broadcast(real)).groupBy("slope").agg(F.avg((F.abs("b") >= F.abs("slope")).cast("double")).alias("p_value"), F.count("*").alias("shuffles"))


def drift_report(periods: Mapping[int, DataFrame], numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """PSI, and KS of numbers, of each feature between consecutive periods, with a status."""
    years, parts = sorted(periods), []
    for a, b in zip(years, years[1:], strict=False):
        before, after = periods[a], periods[b]
        of = lambda c, kind, df, a=a, b=b: df.select(F.lit(a).alias("from_year"), F.lit(b).alias("to_year"), F.lit(c).alias("feature"), F.lit(kind).alias("kind"), "psi", "ks")
        for c in numeric:
            parts.append(of(c, "numeric", stats.psi_numeric(before, after, c).join(F.broadcast(stats.ks(before, after, c)))))  # one row
        for c in categorical:
            parts.append(of(c, "categorical", stats.psi_categorical(before, after, c).withColumn("ks", F.lit(None).cast("double"))))
    status = F.when(F.col("psi") < 0.10, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("major")
    return stats.union_all(parts).withColumn("status", status)


def concept_drift(panels: Mapping[str, DataFrame], score: str = "opportunity", outcome: str = "growth_abs") -> DataFrame:
    """By panel: rank correlation of the score with the outcome, and the lift of the top tenth of the score."""
    from . import backtest

    parts = []
    for name, panel in panels.items():
        panel = materialise(panel.select("npi", score, outcome))
        top = panel.join(F.broadcast(ranks.quantile(panel, score, 0.9, "__cut"))).agg(F.avg(F.when(F.col(score) >= F.col("__cut"), F.col(outcome))).alias("t"), F.avg(outcome).alias("m"))  # one row
        parts.append(top.select(F.lit(name).alias("panel"), (F.col("t") / F.greatest("m", F.lit(1e-9))).alias("top_decile_lift")).join(F.broadcast(backtest.spearman(panel, score, outcome))))
    return stats.union_all(parts)


def retrain(drift: DataFrame, concept: DataFrame, last: int, score: str = "opportunity", score_limit: float = 0.10, moved: float = 0.05) -> DataFrame:
    """One row: whether an input's PSI is major, the score's is at its limit, or its rank correlation with outcomes moved, and so whether to refit."""
    now = drift.where(F.col("to_year") == last)
    d = now.agg(F.coalesce(F.max(F.when(F.col("feature") != score, F.col("psi"))), F.lit(0.0)).alias("worst_input_psi"), F.coalesce(F.max(F.when(F.col("feature") == score, F.col("psi"))), F.lit(0.0)).alias("score_psi"))
    c = concept.agg((F.max_by("spearman", "panel") - F.min_by("spearman", "panel")).alias("spearman_change"))
    out = d.join(F.broadcast(c))  # one row
    return out.withColumn("retrain", (F.col("worst_input_psi") >= 0.25) | (F.col("score_psi") >= score_limit) | F.coalesce(F.abs("spearman_change") > moved, F.lit(False)))
