"""Queries of the fitted models over the bound tables, with the operators' own settings; SQL can't express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, market, models, stats
from ..operators import opportunity as O
from . import fixture as T
from .core import _panel
from .registry import query

Spark = SparkSession
COVARIATES = ["log_panel_benes", "log_non_class_clms", "risk_score", "class_fills", "brand_fills"]
TAUS = [0.65, 0.70, 0.75, 0.85, 0.90]


def _fit_rows(s: Spark, d: str) -> DataFrame:
    return models.materialise(T.mart(s, d).where(F.col("year") == T.FIT))


def _causal(s: Spark, d: str) -> DataFrame:
    """Growth panel with the focus touches of the fit year."""
    pay = T.payments(s, d).where(F.col("year") == T.FIT).select("npi", "pay_focus")
    framed, _ = O.feature_frame(_panel(s, d))
    out = framed.join(pay, "npi", "left").withColumn("log_pay", F.log1p(F.coalesce("pay_focus", F.lit(0.0))))
    return out.withColumn("treated", (F.col("log_pay") > 0).cast("double"))


@query(None)
def d9_d10_boosted_frontier(s: Spark, d: str) -> DataFrame:
    m = _fit_rows(s, d)
    return models.fit_frontier(m).predict(m)


@query(None)
def d9_frontier_coverage(s: Spark, d: str) -> DataFrame:
    m = _fit_rows(s, d)
    return models.coverage(m, models.fit_frontier(m))


@query(None)
def d13_linear_crosscheck(s: Spark, d: str) -> DataFrame:
    m = _fit_rows(s, d)
    both = models.linear_frontier(m).join(models.fit_frontier(m).predict(m), "npi")
    return backtest.spearman(models.materialise(both), "linear_frontier", "frontier")


@query(None)
def d14_permutation_importance(s: Spark, d: str) -> DataFrame:
    m = _fit_rows(s, d)
    return models.permutation_importance(m, models.fit_frontier(m))


@query(None)
def d15_tau_sensitivity(s: Spark, d: str) -> DataFrame:
    m = _fit_rows(s, d)
    bench = models.materialise(market.peer_benchmark(T.mart(s, d)))
    return models.tau_sensitivity(m, lambda f: O.score(m, bench, f, ["npi"]), TAUS)


@query(None)
def d23_refitted_holdout(s: Spark, d: str) -> DataFrame:
    """The back-test's frame with the boosted frontier of the fit period."""
    m = _fit_rows(s, d)
    scored = O.score(m, market.peer_benchmark(T.mart(s, d)), models.fit_frontier(m).predict(m), ["npi"])
    return backtest.holdout_frame(scored, T.mart(s, d).where(F.col("year") == T.HOLDOUT)).select("npi", "opportunity", "opportunity_decile", "brand_growth_abs", "brand_growth_pct", "share_growth", "flagged")


@query(None)
def d30_ev2_challenger_ladder(s: Spark, d: str) -> DataFrame:
    """Models of absolute and share growth, fitted on the panel before, against volume and the frontier."""
    m = T.mart(s, d)
    train = models.materialise(backtest.growth_panel(T.scored(s, d, 1998), m.where("year = 1999")))
    p = models.materialise(_panel(s, d))
    made = models.fit_states(train, {f"predicted_{t}": models.Fit(t) for t in ("growth_abs", "growth_share")}, **models.FRONTIER)
    out = p.join(made.predict(p), "npi")
    return backtest.evaluate_rules(models.materialise(out), {"volume": "class_fills", "frontier": "opportunity", "challenger_abs": "predicted_growth_abs", "challenger_share": "predicted_growth_share"}, 100)


@query(None)
def rs14_rs15_double_ml(s: Spark, d: str) -> DataFrame:
    rows = models.materialise(_causal(s, d).select("npi", "growth_share", "log_pay", *COVARIATES, *O.CATEGORICAL))
    # What the strongest covariate explains of the treatment is the yardstick for the robustness values.
    bench = rows.agg(*[(F.corr(c, "log_pay") ** 2).alias(c) for c in COVARIATES]).select(F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in COVARIATES]).alias("benchmark_r2"))
    return models.double_ml(rows, "growth_share", "log_pay", COVARIATES).join(F.broadcast(bench))  # one row


def _uplift(s: Spark, d: str) -> DataFrame:
    return models.uplift(_causal(s, d), "growth_share", "treated", COVARIATES)


@query(None)
def rs17_rs18_uplift_deciles(s: Spark, d: str) -> DataFrame:
    return models.uplift_deciles(_uplift(s, d))


@query(None)
def rs18_qini(s: Spark, d: str) -> DataFrame:
    return models.qini(_uplift(s, d))


@query(None)
def rs18_list_totals(s: Spark, d: str) -> DataFrame:
    """Expected uplift of equal lists by rule."""
    p = models.materialise(_panel(s, d).select("npi", "opportunity", "class_fills").join(_uplift(s, d), "npi"))
    return stats.list_uplift(p, {"volume": "class_fills", "frontier": "opportunity", "uplift": "tau"}, 150)
