"""Forecasts of the next period: a hurdle, conformal quantile intervals, and counts with a Poisson loss."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import size_band
from ..functions.session import materialise
from . import boosting, models, ranks, stats

ALPHA = 0.10
#: A band with no more calibration rows than this takes the constant of all rows.
LEAST_BAND = 50


def half(seed: int) -> Column:
    """Whether an account is in the half that models are fitted on; the other half calibrates."""
    return F.pmod(F.xxhash64("npi", F.lit(seed)), F.lit(2)) == 0


def conformity(low: str, high: str, actual: str) -> Column:
    """How far the outcome is outside its interval (negative: inside)."""
    return F.greatest(F.col(low) - F.col(actual), F.col(actual) - F.col(high))


def qhat(scores: DataFrame, score: str, alpha: float = ALPHA, by: str | None = None, key: str = "npi") -> DataFrame:
    """The split-conformal constant: one row, or ``by, n, qhat``.

    It is the quantile at ceil((n + 1)(1 - alpha)) / n, at most 1, that takes the next higher score, found by its
    explicit rank.
    """
    rows = scores.where(F.col(score).isNotNull()).withColumn("__by", F.col(by) if by else F.lit(0))
    ranked = ranks.rank_within(rows.select("__by", key, score), ["__by"], [F.col(score), F.col(key)], rank="__rn", total="n")
    level = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"), F.lit(1.0))
    # The rank counts from 0; a product within rounding of a whole number is that number.
    at = F.ceil(F.round(level * (F.col("n") - 1), 9)) + 1
    out = ranked.where(F.col("__rn") == at).select(F.col("__by").alias(by or "__by"), "n", F.col(score).alias("qhat"))
    return out if by else out.drop("__by")


@dataclass
class Intervals:
    """Quantile models of the outcome in log space, given that it isn't 0."""

    encode: PipelineModel
    numeric: list[str]
    quantiles: dict[str, boosting.Boosted]

    def predict(self, df: DataFrame) -> DataFrame:
        return boosting.predict(models.encoded_states(df, self.encode, self.numeric), self.quantiles).drop("x")


def fit_intervals(train: DataFrame, actual: str = "brand_fills_next", alpha: float = ALPHA, *, median: bool = False, **options: float) -> Intervals:
    """Quantiles at alpha / 2 and 1 - alpha / 2, and with ``median`` at one half, of log1p of outcomes above 0."""
    encode, numeric = models.state_encoder(train)
    rows = materialise(models.encoded_states(train.where(F.col(actual) > 0), encode, numeric).select("x", F.log1p(actual).alias("__y")))
    taus = {"lo": alpha / 2, "hi": 1 - alpha / 2} | ({"mid": 0.5} if median else {})
    return Intervals(encode, numeric, models.boost_quantiles(rows, taus, models.categories_of(numeric), **models.MEANS | options))


def interval_coverage(train: DataFrame, after: DataFrame, actual: str = "brand_fills_next", alpha: float = ALPHA, segments: tuple[str, ...] = ("size_band", "specialty_group", "region", "rural"), least: int = 200, seed: int = 0, **options: float) -> DataFrame:
    """Coverage and median width by segment of raw, conformal and band-wise conformal intervals on the next panel, and in the calibration half."""
    band = size_band(F.col("class_fills"))
    train, after = (materialise(models.state_columns(d.withColumn("size_band", band).withColumn("rural", F.when(F.col("rural"), "rural").otherwise("urban")), [actual, *segments, "size_band"])) for d in (train, after))
    model = fit_intervals(train.where(half(seed)), actual, alpha, **options)
    y = F.log1p(actual)
    calibration = materialise(model.predict(train.where(~half(seed)).where(F.col(actual) > 0)).withColumn("y", y).withColumn("score", F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi"))))
    q = qhat(calibration, "score", alpha).select(F.col("qhat").alias("q"))
    banded = qhat(calibration, "score", alpha, "size_band").where(F.col("n") > LEAST_BAND).select("size_band", F.col("qhat").alias("qb"))  # a row per band
    out = materialise(model.predict(after.where(F.col(actual) > 0)).withColumn("y", y))

    def covered(df: DataFrame, shift: Column, name: str) -> DataFrame:
        widened = df.withColumns({"y": F.expm1("y"), "low": F.expm1(F.col("lo") - shift), "high": F.expm1(F.col("hi") + shift)})
        return stats.coverage(widened, list(segments), "low", "high", "y", least).withColumn("variant", F.lit(name))

    with_q = lambda d: d.join(F.broadcast(q)).join(F.broadcast(banded), "size_band", "left")  # noqa: E731  one row; a row per band
    return stats.union_all([covered(with_q(calibration), F.col("q"), "calibration half"), covered(out, F.lit(0.0), "raw quantiles"), covered(with_q(out), F.col("q"), "conformal"), covered(with_q(out), F.coalesce("qb", "q"), "conformal by band")])


def hurdle(train: DataFrame, after: DataFrame, actual: str = "brand_fills_next", **options: float) -> DataFrame:
    """One row: AUC and Brier score on the next panel of the probability that the outcome isn't 0, with the share that it isn't."""
    active = (F.coalesce(F.col(actual), F.lit(0.0)) > 0).cast("double")
    model = models.fit_states(train.withColumn("active", active), {"p_active": models.Fit("active", (0.0, 1.0))}, **options)
    out = materialise(after.select("npi", active.alias("active")).join(model.predict(after), "npi"))
    auc = BinaryClassificationEvaluator(rawPredictionCol="p_active", labelCol="active").evaluate(out)
    return out.agg(F.count("*").alias("n"), F.avg("active").alias("active_share"), F.lit(auc).alias("auc"), F.avg((F.col("p_active") - F.col("active")) ** 2).alias("brier"))


def hurdle_calibration(train: DataFrame, after: DataFrame, actual: str = "brand_fills_next", **options: float) -> DataFrame:
    """Predicted and actual share of active accounts by decile of the prediction."""
    active = (F.coalesce(F.col(actual), F.lit(0.0)) > 0).cast("double")
    model = models.fit_states(train.withColumn("active", active), {"p_active": models.Fit("active", (0.0, 1.0))}, **options)
    return stats.calibration(materialise(after.select("npi", active.alias("active")).join(model.predict(after), "npi")), "p_active", "active")


def forecast(panel: DataFrame, latest: DataFrame, actual: str = "brand_fills_next", alpha: float = ALPHA, seed: int = 1, **options: float) -> DataFrame:
    """``npi, p_active, lo, median, hi``: what the next period brings, fitted on a half of the last panel and calibrated on the other.

    Ends are in order and at least 0, and the median is inside. Calibration is over all sizes at once.
    """
    panel = materialise(models.state_columns(panel, [actual]))
    active = (F.coalesce(F.col(actual), F.lit(0.0)) > 0).cast("double")
    fitted = panel.where(half(seed))
    classifier, intervals = models.in_parallel([lambda: models.fit_states(fitted.withColumn("active", active), {"p_active": models.Fit("active", (0.0, 1.0))}, **options), lambda: fit_intervals(fitted, actual, alpha, median=True, **options)])
    calibration = intervals.predict(panel.where(~half(seed)).where(F.col(actual) > 0)).withColumn("__y", F.log1p(actual))
    q = qhat(materialise(calibration.select("npi", conformity("lo", "hi", "__y").alias("score"))), "score", alpha).select(F.col("qhat").alias("__q"))
    latest = materialise(models.state_columns(latest))
    out = intervals.predict(latest).select("npi", "lo", "mid", "hi").join(F.broadcast(q))  # one row
    low, high = F.least(F.col("lo") - F.col("__q"), F.col("hi") + F.col("__q")), F.greatest(F.col("lo") - F.col("__q"), F.col("hi") + F.col("__q"))
    middle = F.least(F.greatest(F.col("mid"), low), high)
    zero = lambda c: F.greatest(F.expm1(c), F.lit(0.0))
    return out.select("npi", zero(low).alias("lo"), zero(middle).alias("median"), zero(high).alias("hi")).join(classifier.predict(latest), "npi").select("npi", "p_active", "lo", "median", "hi")


def poisson_counts(train: DataFrame, after: DataFrame, actual: str = "brand_fills_next", **options: float) -> DataFrame:
    """``npi, predicted``: expected counts by boosting with a Poisson loss on the state; a missing count is 0."""
    encode, numeric = models.state_encoder(train)
    rows = models.encoded_states(train, encode, numeric).select("x", F.greatest(F.coalesce(F.col(actual), F.lit(0.0)), F.lit(0.0)).alias("__t"))
    made = boosting.fit(rows, {"predicted": boosting.Target("__t", "poisson")}, categorical=models.categories_of(numeric), **models.MEANS | options)
    return boosting.predict(models.encoded_states(after, encode, numeric).select("npi", "x"), made).drop("x")
