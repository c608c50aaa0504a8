"""Rule ladders, shrinkage comparisons, ceilings, practice networks and the bootstrapped blend frontier."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import materialise
from . import draws, models, ranks, resample, stats
from .blends import GUARDRAIL
from .opportunity import stack_rules

#: What lists are measured by.
OUTCOMES = ("growth_abs", "eb_growth_share", "eb_share_fills")


def rule_metrics(panel: DataFrame, rules: Mapping[str, str], k: int) -> DataFrame:
    """By rule: value, absolute and share capture, precision against the top tenth of value, NDCG, net growth and median base of its list.

    ``panel``: npi, class_fills, growth_abs, eb_growth_share, eb_share_fills and the rules' columns.
    """
    pos = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    rows = materialise(panel.select("npi", *set(rules.values()), "class_fills" if "class_fills" not in rules.values() else F.col("class_fills").alias("__v"), F.coalesce("growth_abs", F.lit(0.0)).alias("net"), F.coalesce("eb_share_fills", F.lit(0.0)).alias("gain"), pos("eb_share_fills").alias("gv"), pos("growth_abs").alias("ga"), pos("eb_growth_share").alias("ge")))
    totals = rows.agg(F.sum("gv").alias("tv"), F.sum("ga").alias("ta"), F.sum("ge").alias("te"), F.percentile_approx("gain", 0.9, 10_000).alias("cut"))
    best = ranks.global_scan(ranks.top_k(rows.select("npi", "gv"), "gv", k), [F.desc("gv"), F.col("npi")]).agg(F.sum(F.col("gv") / F.log2(F.col("rn") + 1.0)).alias("ideal"))
    listed = ranks.top_k_by_rule(stack_rules(rows, rules, ["npi", "class_fills", "net", "gain", "gv", "ga", "ge"]), k)
    got = listed.join(F.broadcast(totals)).groupBy("rule").agg(F.sum("gv").alias("v"), F.sum("ga").alias("a"), F.sum("ge").alias("e"), F.avg((F.col("gain") >= F.col("cut")).cast("double")).alias("precision_at_k"), F.sum(F.col("gv") / F.log2(F.col("position") + 1.0)).alias("dcg"), F.sum("net").alias("net_growth"), F.percentile("class_fills", 0.5).alias("median_base"))  # one row; a list has k rows
    out = got.join(F.broadcast(totals)).join(F.broadcast(best))
    return out.select("rule", F.try_divide("v", "tv").alias("value_capture"), F.try_divide("a", "ta").alias("abs_capture"), F.try_divide("e", "te").alias("eb_share_capture"), "precision_at_k", F.try_divide("dcg", "ideal").alias("ndcg_at_k"), "net_growth", "median_base")


def ladder(panel: DataFrame, rules: Mapping[str, str], k: int, *, reps: int = 100, baseline: str = "volume", seed: int = 31) -> DataFrame:
    """``rule_metrics`` with bootstrap intervals of the value capture, the ratio to the baseline's absolute capture and the guardrail."""
    panel = materialise(panel.select("npi", *dict.fromkeys(["class_fills", *OUTCOMES, *rules.values()])))
    table = materialise(rule_metrics(panel, rules, k))
    drawn = resample.bootstrap_capture(panel, rules, "eb_share_fills", k, reps, seed, baseline).select("rule", F.col("capture_low").alias("value_capture_low"), F.col("capture_high").alias("value_capture_high"))
    base = table.where(F.col("rule") == baseline).select(F.col("abs_capture").alias("b"))
    out = table.join(drawn, "rule").join(F.broadcast(base)).withColumn("abs_vs_volume", F.try_divide("abs_capture", "b")).drop("b")  # one row
    return out.withColumn("passes_guardrail", F.coalesce(F.col("abs_vs_volume") >= GUARDRAIL, F.lit(False)))


def ladder_panel(train: DataFrame, after: DataFrame, seed: int = 0) -> tuple[DataFrame, dict[str, str]]:
    """The next panel's states and outcomes with the scores of eight rules, three of them boosted on the panel before."""
    targets = {"gbm_abs": "growth_abs", "gbm_share_raw": "growth_share", "gbm_value": "eb_share_fills"}
    train, after = materialise(models.state_columns(train, targets.values())), materialise(models.state_columns(after, ["opportunity", "momentum", *OUTCOMES]))
    made = models.fit_states(train, {n: models.Fit(c) for n, c in targets.items()})
    out = ranks.percent_rank(ranks.percent_rank(after, "opportunity", "__ro"), "class_fills", "__rv")
    out = out.withColumn("hybrid", (F.col("__ro") + F.col("__rv")) / 2).drop("__ro", "__rv").withColumn("random", F.xxhash64("npi", F.lit(seed)).cast("double")).withColumn("momentum", F.coalesce("momentum", F.lit(0.0)))
    return materialise(out.join(made.predict(after), "npi")), {"random": "random", "volume": "class_fills", "momentum": "momentum", "frontier": "opportunity", "hybrid": "hybrid"} | {n: n for n in targets}


def shrinkage_comparison(train: DataFrame, after: DataFrame, k: int, cap: float = 2000.0) -> DataFrame:
    """Lists of models of the raw, shrunk, precision-weighted and value-aligned change of share: base, captures and net growth."""
    weight = F.least(F.greatest(F.coalesce("class_fills_observed", F.lit(0.0)), F.lit(1.0)), F.lit(cap))
    targets = ("growth_share", "eb_growth_share", "eb_share_fills")
    train, after = materialise(models.state_columns(train.withColumn("precision", weight), ["precision", *targets])), materialise(models.state_columns(after, OUTCOMES))
    specs = {"ml_share_raw": ("growth_share", None), "ml_share_eb": ("eb_growth_share", None), "ml_share_eb_weighted": ("eb_growth_share", "precision"), "ml_share_value_aligned": ("eb_share_fills", None)}
    made = models.fit_states(train, {n: models.Fit(t, weight=w) for n, (t, w) in specs.items()})
    return rule_metrics(materialise(after.join(made.predict(after), "npi")), {n: n for n in specs}, k).select("rule", "median_base", "abs_capture", "eb_share_capture", "net_growth")


def mean_reversion(panel: DataFrame, small: float = 20.0) -> DataFrame:
    """One row: correlation of the shrunk share with its change, and deviations of raw and shrunk changes of small and large accounts."""
    on = F.coalesce(F.col("class_fills_observed") < small, F.lit(True))
    sd = lambda c, cond: F.stddev_samp(F.when(cond, F.col(c)))
    return panel.agg(F.corr("eb_share", "eb_growth_share").alias("mean_reversion"), sd("growth_share", on).alias("sd_raw_small"), sd("eb_growth_share", on).alias("sd_shrunk_small"), sd("growth_share", ~on).alias("sd_raw_large"), sd("eb_growth_share", ~on).alias("sd_shrunk_large"))


# Ceilings


def _draw_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Poisson trials and binomial hits of whole batches, from hashed uniform numbers."""
    for b in batches:
        key, rep = b["h"].to_numpy(np.int64), b["rep"].to_numpy()
        n = draws.poisson(b["n"].to_numpy(float), draws.uniforms(key, rep, 1))
        y = draws.binomial(n, b["p"].to_numpy(float), draws.uniforms(key, rep, 2))
        yield b.drop(columns=["h", "n", "p"]).assign(n=n, y=y)


def noise_ceiling(panel: DataFrame, priors: DataFrame, k: int, reps: int = 30, seed: int = 41, group: str = "specialty_group") -> DataFrame:
    """One row: what a list captures that knows every account's expected behaviour (mean and deviation over draws), and one that knows the outcome.

    Next-period counts are drawn anew from the observed ones: Poisson trials and binomial hits, by key and draw.
    """
    n = F.greatest(F.coalesce("class_obs_next", F.lit(0.0)), F.lit(0.0))
    y = F.greatest(F.coalesce("brand_fills_next", F.lit(0.0)), F.lit(0.0))
    panel = materialise(panel.select("npi", group, "class_fills", "eb_share", "eb_share_fills", "class_obs_next", "brand_fills_next"))
    listed = ranks.top_k(panel.select("npi", F.col("eb_share_fills").alias("v")), "v", k).select("npi", F.lit(1).alias("listed"))
    base = materialise(panel.select("npi", group, "eb_share", "class_fills", n.alias("n"), F.least(F.coalesce(F.try_divide(y, F.nullif(n, F.lit(0.0))), F.lit(0.0)), F.lit(1.0)).alias("p"), F.greatest("eb_share_fills", F.lit(0.0)).alias("gv")).join(listed, "npi", "left"))
    every = base.select("npi", group, "eb_share", "class_fills", "listed", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"), F.xxhash64("npi", F.lit(seed)).alias("h"), "n", "p")
    types = dict(base.dtypes)
    counts = every.mapInPandas(_draw_counts, f"npi {types['npi']}, {group} {types[group]}, eb_share double, class_fills double, listed int, rep int, n double, y double")
    value = (F.col("next") - F.col("eb_share")) * F.greatest("class_fills", F.lit(0.0))
    gain = F.greatest(value, F.lit(0.0))
    per = stats.shrink(counts, priors, group, "y", "n", "next").groupBy("rep").agg(F.try_divide(F.sum(F.when(F.col("listed") == 1, gain)), F.sum(gain)).alias("c"))
    known = base.agg(F.try_divide(F.sum(F.when(F.col("listed") == 1, F.col("gv"))), F.sum("gv")).alias("hindsight"))
    return per.agg(F.avg("c").alias("noise_ceiling"), F.stddev_samp("c").alias("deviation"), F.count("*").alias("draws")).join(F.broadcast(known))  # one row


def ceiling_table(metrics: DataFrame, ceiling: DataFrame) -> DataFrame:
    """Value captures of rules and ceilings, and their shares of both ceilings."""
    ceiling = materialise(ceiling)
    rows = metrics.select("rule", "value_capture", F.lit("rule").alias("kind"))
    rows = rows.unionByName(ceiling.select(F.explode(F.array(F.struct(F.lit("hindsight").alias("rule"), F.col("hindsight").alias("value_capture")), F.struct(F.lit("noise ceiling").alias("rule"), F.col("noise_ceiling").alias("value_capture")))).alias("x")).select("x.rule", "x.value_capture", F.lit("ceiling").alias("kind")))
    out = rows.join(F.broadcast(ceiling.select("noise_ceiling", "hindsight")))  # one row
    return out.select("rule", "kind", "value_capture", F.try_divide("value_capture", "noise_ceiling").alias("share_of_noise_ceiling"), F.try_divide("value_capture", "hindsight").alias("share_of_hindsight"))


# Practices

MAX_PRACTICE = 500


def practices(links: DataFrame, accounts: DataFrame, most: int = MAX_PRACTICE) -> DataFrame:
    """Distinct memberships (npi, practice) of the accounts in practices of 2 to ``most`` of them."""
    m = links.dropna(subset=["practice"]).select("npi", "practice").distinct().join(accounts.select("npi"), "npi", "left_semi")
    return m.join(m.groupBy("practice").agg(F.count("*").alias("c")).where(F.col("c").between(2, most)).select("practice"), "practice", "left_semi")


def _first_practice(members: DataFrame) -> DataFrame:
    return members.groupBy("npi").agg(F.min("practice").alias("practice"))


def practice_icc(members: DataFrame, panel: DataFrame, value: str, reps: int = 20, seed: int = 51) -> DataFrame:
    """One row: intraclass correlation of a value in practices (an account's first), against its shuffles over all accounts."""
    every = materialise(resample.shuffled(panel.select("npi", value).dropna(), value, reps, seed).join(_first_practice(members), "npi"))
    g = every.groupBy("rep", "practice").agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v")).where("n > 1")
    t = g.groupBy("rep").agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"))
    between, inside = F.try_divide(F.col("nmm") - F.col("nm") * F.col("nm") / F.col("N"), F.col("k") - 1), F.try_divide("ssw", F.col("N") - F.col("k"))
    size = F.try_divide(F.col("N") - F.col("nn") / F.col("N"), F.col("k") - 1)
    per = t.select("rep", F.try_divide(between - inside, between + (size - 1) * inside).alias("icc"))
    return per.agg(F.max(F.when(F.col("rep") == 0, F.col("icc"))).alias("icc"), F.percentile(F.when(F.col("rep") > 0, F.col("icc")), 0.975).alias("null_high"), F.count_if(F.col("rep") > 0).alias("shuffles")).withColumn("clustered", F.col("icc") > F.col("null_high"))


def with_peers(panel: DataFrame, members: DataFrame, change: str) -> DataFrame:
    """Mates' mean share and mean change (of a column), and whether there are any; without mates the own share and 0."""
    values = panel.select("npi", "eb_share", F.coalesce(F.col(change), F.lit(0.0)).alias("__change"))
    share = stats.leave_one_out(members, values, "eb_share").select("npi", F.col("peer_mean").alias("peer_share"))
    moved = stats.leave_one_out(members, values, "__change").select("npi", F.col("peer_mean").alias("peer_prior_change"))
    out = panel.join(share, "npi", "left").join(moved, "npi", "left").withColumn("has_peers", F.col("peer_share").isNotNull().cast("double"))
    return out.withColumn("peer_share", F.coalesce("peer_share", "eb_share")).withColumn("peer_prior_change", F.coalesce("peer_prior_change", F.lit(0.0)))


def peer_value(train: DataFrame, after: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Metrics of the value model's list with and without what practice mates do."""
    extra = ("peer_share", "peer_prior_change", "has_peers")
    train, after = models.state_columns(train, ["eb_share", "growth_share", "eb_share_fills"]), models.state_columns(after, ["eb_share", "prior_growth_share", *OUTCOMES])
    train, after = models.in_parallel([lambda: materialise(with_peers(train, members, "growth_share")), lambda: materialise(with_peers(after, members, "prior_growth_share"))])
    plain, peers = models.in_parallel([lambda: models.fit_states(train, {"value_model": models.Fit("eb_share_fills")}), lambda: models.fit_states(train, {"value_model_with_peers": models.Fit("eb_share_fills")}, extra=extra)])
    return rule_metrics(after.join(plain.predict(after), "npi").join(peers.predict(after), "npi"), {n: n for n in ("value_model", "value_model_with_peers")}, k)


def unlisted_mates(panel: DataFrame, listed: DataFrame, members: DataFrame, value: str = "eb_share_fills") -> DataFrame:
    """One row: practice mates of a list that aren't on it, and the share of all value that they hold."""
    mates = members.join(members.join(listed.select("npi"), "npi", "left_semi").select("practice"), "practice", "left_semi").select("npi").distinct().join(listed.select("npi"), "npi", "left_anti")
    gain = panel.select("npi", F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0)).alias("g"))
    held = gain.join(mates.withColumn("__mate", F.lit(1)), "npi", "left")
    return held.agg(F.count("__mate").alias("mates"), F.try_divide(F.sum(F.when(F.col("__mate") == 1, F.col("g"))), F.sum("g")).alias("value_share"))
