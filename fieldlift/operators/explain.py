"""Attribution of the boosted frontier to features along tree paths, and ablations of its inputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import materialise
from . import backtest, models, ranks, stats
from .boosting import Trees
from .opportunity import CATEGORICAL, potential, stack_rules

TOP = 5


def expected_values(trees: Trees) -> np.ndarray:
    """By tree and node the mean of the leaves' values below it, weighted by their training rows."""
    out = trees.value.copy()
    for node in range(out.shape[1] // 2 - 1, -1, -1):
        inner = trees.feature[:, node] >= 0
        l, r = 2 * node + 1, 2 * node + 2
        count = trees.count[:, l] + trees.count[:, r]
        mean = (out[:, l] * trees.count[:, l] + out[:, r] * trees.count[:, r]) / np.maximum(count, 1)
        out[inner, node] = mean[inner]
    return out


def path_contributions(trees: Trees, bins: np.ndarray) -> tuple[float, np.ndarray]:
    """Base value and contributions (row, feature): at each split a row's expected value changes, and the split's feature earns it."""
    value = expected_values(trees)
    base, out, every = trees.start + trees.rate * value[:, 0].sum(), np.zeros(bins.shape), np.arange(len(bins))
    for t in range(len(value)):
        node = np.zeros(len(bins), np.int64)
        for _ in range(trees.depth):
            f = trees.feature[t][node]
            seen = np.maximum(f, 0)
            after = np.where(f >= 0, 2 * node + 2 - trees.left[t][node, bins[every, seen]], node)
            out[every, seen] += np.where(f >= 0, value[t][after] - value[t][node], 0.0)
            node = after
    return float(base), trees.rate * out


def attribution(df: DataFrame, model: models.Frontier) -> DataFrame:
    """``npi, prediction, base`` and ``contributions`` (array of feature and log contribution, in the features' order) by account.

    Contributions and base add up to the prediction in log space. Categories are one feature each.
    """
    names = [*model.features, *CATEGORICAL]
    binning, trees = model.model.binning, model.model.trees
    framed, _ = models.feature_frame(df)
    rows = model.encoded(framed.select("npi", *model.features, *CATEGORICAL)).select("npi", vector_to_array("x").alias("x"))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                base, found = path_contributions(trees, binning.of(np.stack(batch["x"].to_numpy())))
                yield pd.DataFrame({"npi": batch["npi"], "prediction": base + found.sum(1), "base": base, "values": list(found)})

    out = rows.mapInPandas(explain, "npi long, prediction double, base double, values array<double>")
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("values").alias("contribution"))
    return out.select("npi", "prediction", "base", pairs.alias("contributions"))


def top_drivers(explained: DataFrame, n: int = TOP) -> DataFrame:
    """``npi, rank, feature, contribution, multiplier``: the ``n`` contributions of largest size by account."""
    sized = F.transform("contributions", lambda c: F.struct((-F.abs(c["contribution"])).alias("s"), c["feature"].alias("feature"), c["contribution"].alias("contribution")))
    out = explained.select("npi", F.posexplode(F.slice(F.array_sort(sized), 1, n)).alias("rank", "c"))
    return out.select("npi", (F.col("rank") + 1).alias("rank"), "c.feature", "c.contribution", F.exp("c.contribution").alias("multiplier"))


def global_drivers(explained: DataFrame) -> DataFrame:
    """Mean size of the contributions by feature, and its share."""
    g = explained.select(F.explode("contributions").alias("c")).groupBy("c.feature").agg(F.avg(F.abs("c.contribution")).alias("mean_size"))
    total = g.agg(F.sum("mean_size").alias("t"))
    return g.join(F.broadcast(total)).select("feature", "mean_size", F.coalesce(F.try_divide("mean_size", F.nullif("t", F.lit(0.0))), F.lit(0.0)).alias("share"))  # one row


def fidelity(df: DataFrame, model: models.Frontier, importance: DataFrame) -> DataFrame:
    """One row: rank correlation of the explained prediction with the model's, and of global contributions with another importance."""
    explained = materialise(attribution(df, model))
    both = materialise(explained.select("npi", "prediction").join(model.predict(df), "npi"))
    shares = materialise(global_drivers(explained).join(importance.select("feature", F.col("share").alias("other")), "feature"))
    own = backtest.spearman(both, "prediction", "frontier").toDF("fidelity_spearman")
    return own.join(F.broadcast(backtest.spearman(shares, "share", "other").toDF("agreement_spearman")))  # one row


def ablation(df: DataFrame, benchmarks: DataFrame, outcomes: DataFrame, k: int, variants: dict[str, dict], tau: float = 0.8, value: str = "eb_share_fills") -> DataFrame:
    """Variants of the frontier by what their lists of ``k`` capture and how they rank accounts against the first one.

    A variant may have ``keep`` (numeric features), ``flatten`` (categories made one), ``tau`` and ``national`` (one achievable
    share for all). ``outcomes``: npi, class_fills, growth_abs and the value. The first variant is the production one.
    """
    df = materialise(df)
    names = {n: f"__f{j}" for j, n in enumerate(variants)}
    predicted = models.predict_frontiers(df, {names[n]: f for n, f in models.fit_frontiers(df, {n: {"tau": tau} | v for n, v in variants.items()}).items()})
    rows = materialise(df.join(predicted, "npi", "left"))
    middle = materialise(benchmarks.agg(F.median("achievable_share").alias("__m")))  # few distinct values: one per cell

    def opportunity(name: str, spec: dict) -> DataFrame:
        flat = tuple(spec.get("flatten", ()))
        bench = benchmarks
        if spec.get("national"):
            bench = bench.join(F.broadcast(middle)).withColumn("achievable_share", F.col("__m")).drop("__m")  # one row
        if flat:
            keys = [c for c in (*CATEGORICAL, "year") if c not in flat]
            bench = bench.groupBy(*keys).agg(F.median("achievable_share").alias("achievable_share")).withColumns({c: F.lit("All") for c in flat})
        own = rows.select("npi", *[F.lit("All").alias(c) if c in flat else c for c in CATEGORICAL], "year", "class_fills", "brand_fills", F.col(names[name]).alias("frontier"))
        return materialise(potential(own, bench).where("in_market").select("npi", "opportunity"))

    made = models.in_parallel([lambda n=n, s=s: opportunity(n, s) for n, s in variants.items()])
    outcomes = outcomes.select("npi", "class_fills", *[F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(n) for c, n in ((value, "gv"), ("growth_abs", "ga"))])
    outcomes = materialise(ranks.percent_rank(materialise(outcomes), "class_fills", "rv"))
    total = outcomes.agg(F.sum("gv").alias("tv"))

    def capture(name: str, scored: DataFrame) -> DataFrame:
        frame = materialise(outcomes.join(scored, "npi", "left").fillna(0.0, ["opportunity"]))
        ranked = ranks.percent_rank(frame, "opportunity", "ro").withColumn("hybrid", (F.col("ro") + F.col("rv")) / 2)
        lists = ranks.top_k_by_rule(stack_rules(ranked, {"own": "opportunity", "hybrid": "hybrid", "volume": "class_fills"}, ["npi", "gv", "ga"]), k)
        on = lambda r, c: F.sum(F.when(F.col("rule") == r, F.col(c)))
        got = lists.agg(on("own", "gv").alias("own"), on("hybrid", "gv").alias("hyb"), on("hybrid", "ga").alias("hyb_abs"), on("volume", "ga").alias("vol_abs")).join(F.broadcast(total))
        both = materialise(made[0].join(scored.withColumnRenamed("opportunity", "o"), "npi"))
        out = got.select(F.lit(name).alias("variant"), F.try_divide("own", "tv").alias("value_capture"), F.try_divide("hyb", "tv").alias("hybrid_value_capture"), F.try_divide("hyb_abs", "vol_abs").alias("hybrid_abs_vs_volume"))
        return materialise(out.join(F.broadcast(backtest.spearman(both, "opportunity", "o").toDF("spearman_vs_production"))))  # one row

    table = stats.union_all(models.in_parallel([lambda n=n, s=s: capture(n, s) for n, s in zip(variants, made, strict=True)]))
    first = table.where(F.col("variant") == next(iter(variants))).select(F.col("value_capture").alias("v0"), F.col("hybrid_value_capture").alias("h0"))
    return table.join(F.broadcast(first)).withColumn("value_capture_change", F.col("value_capture") - F.col("v0")).withColumn("hybrid_value_capture_change", F.col("hybrid_value_capture") - F.col("h0")).drop("v0", "h0")  # one row


def stacked(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    from .opportunity import stack_rules

    return stack_rules(df, rules, ["npi", "gv", "ga"])
