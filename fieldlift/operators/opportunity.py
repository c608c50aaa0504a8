"""Frontier features, opportunity scores, deciles and hybrid rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import in_parallel, materialise
from . import ranks

#: Features of the frontier.
LOGS = {"log_panel_benes": "panel_benes", "log_non_class_clms": "non_class_clms", "log_zip3_population": "zip3_population", "log_pop_density": "zip3_pop_density"}
OPTIONAL = {"log_zip3_population", "log_pop_density"}
PLAIN = ("risk_score",)
CATEGORICAL = ("specialty_group", "region")
FORBIDDEN = ("class", "brand", "share", "fills", "growth", "opportunity")
EXEMPT = ("log_non_class_clms", "non_class_clms")


def feature_frame(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Logged counts, medians for missing covariates, "Unknown" for missing categories; and the usable numeric features.

    Optional features that are absent or all null are left out; a required one raises. Medians come from range scans.
    """
    sources = {f: c for f, c in {**LOGS, **{p: p for p in PLAIN}}.items() if c in df.columns}
    facts = df.agg(*[F.count(c).alias(f"n_{f}") for f, c in sources.items()]).first().asDict()
    facts |= {f"m_{p}": ranks.quantile(df, p).first()[0] for p in PLAIN if p in df.columns}
    usable = [f for f in sources if facts[f"n_{f}"]]
    if missing := [f for f in [*LOGS, *PLAIN] if f not in usable and f not in OPTIONAL]:
        raise ValueError(f"required features are missing or all null: {missing}")
    out = df.withColumns({f: F.log1p(F.coalesce(F.col(LOGS[f]), F.lit(0.0))) for f in usable if f in LOGS} | {p: F.coalesce(F.col(p), F.lit(facts[f"m_{p}"])) for p in PLAIN if p in usable} | {c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in CATEGORICAL})
    return out, usable


def leakage(df: DataFrame, features: Sequence[str], target: str, limit: float = 0.97) -> DataFrame:
    """One row per feature: forbidden name, correlation with the target, and whether either makes it leak."""
    named = {f: f not in EXEMPT and any(t in f for t in FORBIDDEN) for f in features}
    row = df.agg(*[F.corr(f, target).alias(f) for f in features])
    long = row.unpivot([], list(features), "feature", "corr")
    by_name = F.coalesce(*[F.when(F.col("feature") == f, F.lit(bad)) for f, bad in named.items()])
    return long.withColumn("forbidden_name", by_name).withColumn("leaks", F.col("forbidden_name") | F.coalesce(F.abs("corr") > limit, F.lit(False)))


def assert_no_leakage(df: DataFrame, features: Sequence[str], target: str, limit: float = 0.97) -> None:
    if bad := [r["feature"] for r in leakage(df, features, target, limit).where("leaks").collect()]:  # a row per feature
        raise ValueError(f"features leak the target: {bad}")


def cell_frontier(df: DataFrame, tau: float = 0.8, by: Sequence[str] = ("specialty_group",)) -> DataFrame:
    """The quantile of in-market volume by group: a frontier without a model."""
    return df.where("class_fills > 0").groupBy(*by).agg(F.percentile("class_fills", tau).alias("frontier"))


def score(df: DataFrame, benchmarks: DataFrame, frontier: DataFrame, by: Sequence[str] = ("specialty_group",)) -> DataFrame:
    """Potential, achievable share, opportunity and deciles; nothing outside the market.

    ``frontier`` has the columns ``by`` (npi for a model's predictions) and ``frontier``. Benchmarks match null regions.
    Rows are written once, before the medians and deciles are taken from them.
    """
    return rank_opportunity(potential(df.join(frontier, list(by), "left"), benchmarks))


def potential(df: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """``score`` without the deciles, of rows that have their ``frontier``."""
    b = benchmarks.select(F.col("specialty_group").alias("__g"), F.col("region").alias("__r"), F.col("year").alias("__y"), "achievable_share")
    out = df.withColumn("potential_class", F.greatest(F.coalesce("frontier", F.lit(0.0)), F.col("class_fills"))).drop("frontier")
    out = out.join(b, out["specialty_group"].eqNullSafe(b["__g"]) & out["region"].eqNullSafe(b["__r"]) & (out["year"] == b["__y"]), "left").drop("__g", "__r", "__y")
    out = materialise(out)
    middle = out.agg(F.median("achievable_share").alias("__m"))  # a benchmark cell has one value, so distinct ones are few
    out = out.join(F.broadcast(middle)).withColumn("achievable_share", F.coalesce("achievable_share", "__m")).drop("__m")  # one row
    return with_opportunity(out)


def with_opportunity(df: DataFrame) -> DataFrame:
    inside = F.col("class_fills") > 0
    brand = F.when(inside, F.col("potential_class") * F.col("achievable_share")).otherwise(0.0)
    out = df.withColumn("in_market", inside).withColumn("potential_brand", brand).withColumn("opportunity", F.when(inside, F.greatest(F.col("potential_brand") - F.col("brand_fills"), F.lit(0.0))).otherwise(0.0))
    return out.withColumn("opportunity_pct_of_potential", F.coalesce(F.try_divide(F.col("opportunity"), F.nullif(F.col("potential_brand"), F.lit(0.0))), F.lit(0.0)))


def rank_opportunity(df: DataFrame) -> DataFrame:
    """Deciles inside the market; 0 outside."""
    inside = materialise(df.where("in_market").select("npi", "opportunity", "class_fills"))  # each scan reads it twice
    by = {"opportunity": "opportunity_decile", "class_fills": "volume_decile"}
    first, second = in_parallel([lambda c=c, n=n: ranks.decile(inside.select("npi", c), c, n).select("npi", n) for c, n in by.items()])
    out = df.join(first.join(second, "npi"), "npi", "left").fillna(0, list(by.values()))
    return out.withColumn("decile_shift", F.col("opportunity_decile") - F.col("volume_decile"))


def hybrid(df: DataFrame, weight: float = 0.5, name: str = "hybrid") -> DataFrame:
    """Weighted percentile ranks of opportunity and volume, in the market."""
    out = ranks.percent_rank(ranks.percent_rank(df.where("in_market"), "opportunity", "opportunity_rank"), "class_fills", "volume_rank")
    return out.withColumn(name, weight * F.col("opportunity_rank") + (1 - weight) * F.col("volume_rank"))


def disagreement(scored: DataFrame) -> DataFrame:
    """Accounts by volume decile and opportunity decile, in the market."""
    return scored.where("in_market").groupBy("volume_decile", "opportunity_decile").agg(F.count("*").alias("accounts"))


def agreement(scored: DataFrame) -> DataFrame:
    shift = F.abs("decile_shift")
    share = lambda c: F.avg(c.cast("double"))
    return scored.where("in_market").agg(F.count("*").alias("accounts"), share(shift == 0).alias("same_decile"), share(shift <= 1).alias("within_1"), share(shift >= 2).alias("moved_2_plus"), F.avg("decile_shift").alias("mean_shift"))


def stack_rules(df: DataFrame, rules: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per account and rule with the rule's ``score``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).cast("double").alias("score")) for r, c in rules.items()])).alias("x")
    return df.select(*keep, pairs).select(*keep, "x.rule", "x.score")
