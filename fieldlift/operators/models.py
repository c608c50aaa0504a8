"""Boosted quantile frontier, cross-fitted effects, uplift and state models on histogram boosting.

All models of a call are grown in one Spark job (``boosting``). What reaches the driver is trees or a row of sums. Encoded rows
are materialised once, so that passes over them don't repeat the joins before.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import in_parallel, materialise
from . import backtest, boosting, ranks, stats
from .boosting import Boosted, Target
from .opportunity import CATEGORICAL, LOGS, PLAIN, feature_frame

#: Critical value of intervals, bounds of propensities.
CRITICAL = 1.96
RESIDUAL_CLIP, UPLIFT_CLIP = (0.01, 0.99), (0.02, 0.98)
#: Rounds, depth, rate, least rows of a leaf and shrinkage of leaves for the frontier, for means and for probabilities.
FRONTIER = {"trees": 300, "depth": 4, "rate": 0.05, "least": 40, "l2": 0.0}
MEANS = {"trees": 200, "depth": 6, "rate": 0.06, "least": 80, "l2": 1.0}
CHANCES = {"trees": 200, "depth": 5, "rate": 0.06, "least": 100, "l2": 1.0}


def encoder(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = CATEGORICAL) -> PipelineModel:
    """Numeric columns and category codes as a vector ``x``; unseen categories get a code of their own."""
    codes = StringIndexer(inputCols=list(categorical), outputCols=[f"__{c}" for c in categorical], handleInvalid="keep")
    vector = VectorAssembler(inputCols=[*numeric, *[f"__{c}" for c in categorical]], outputCol="x")
    return Pipeline(stages=[codes, vector]).fit(df)


def categories_of(numeric: Sequence[str], categorical: Sequence[str] = CATEGORICAL) -> list[int]:
    """Positions of the codes in an encoder's vector."""
    return list(range(len(numeric), len(numeric) + len(categorical)))


def boost_quantiles(rows: DataFrame, taus: Mapping[str, float], categorical: Sequence[int] = (), features: Mapping[str, Sequence[int]] | None = None, **options: float) -> dict[str, Boosted]:
    """Gradient boosting for quantiles of ``__y`` given ``x``, one for each of ``taus``; ``features`` restricts what some of them see.

    Each tree is grown on the gradient of the pinball loss and its leaves are set to the quantile of the residuals. Without rows it raises.
    """
    allowed = {n: tuple(f) for n, f in (features or {}).items()}
    made = boosting.fit(rows, {n: Target("__y", "quantile", t, features=allowed.get(n)) for n, t in taus.items()}, categorical=categorical, **FRONTIER | options)
    if None in made.values():
        raise ValueError("no rows to fit a quantile on")
    return made


@dataclass
class Frontier:
    """A boosted quantile in log space over the features of accounts."""

    encode: PipelineModel
    features: list[str]
    model: Boosted

    @property
    def tau(self) -> float:
        return self.model.tau

    def encoded(self, framed: DataFrame) -> DataFrame:
        """Rows that have the feature columns, with ``x``."""
        return self.encode.transform(framed).drop(*[f"__{c}" for c in CATEGORICAL])

    def log_potential(self, framed: DataFrame) -> DataFrame:
        """Add ``__f`` to rows that have the feature columns."""
        return self.model.predict(self.encoded(framed)).drop("x")

    def predict(self, df: DataFrame) -> DataFrame:
        """``npi, frontier``: potential volume, at least 0."""
        framed, _ = feature_frame(df)
        return self.log_potential(framed.select("npi", *self.features, *CATEGORICAL)).select("npi", F.greatest(F.expm1("__f"), F.lit(0.0)).alias("frontier"))


def _framed(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    framed, usable = feature_frame(df)
    return framed.where(F.col(target) > 0).select("npi", *usable, *CATEGORICAL, F.log1p(target).alias("__y")), usable


def fit_frontiers(df: DataFrame, variants: Mapping[str, Mapping], target: str = "class_fills", **options: float) -> dict[str, Frontier]:
    """Quantiles of log1p(target) over rows with a positive target, all in one fit.

    A variant may have ``tau`` (0.8), ``keep`` (numeric features that it sees) and ``flatten`` (categories that it doesn't see).
    """
    rows, usable = _framed(df, target)
    rows = materialise(rows)
    encode = encoder(rows, usable)
    names = [*usable, *CATEGORICAL]
    seen = {v: [k for k, n in enumerate(names) if n not in spec.get("flatten", ()) and (n in CATEGORICAL or spec.get("keep") is None or n in spec["keep"])] for v, spec in variants.items()}
    made = boost_quantiles(encode.transform(rows), {v: spec.get("tau", 0.8) for v, spec in variants.items()}, categories_of(usable), seen, **options)
    return {v: Frontier(encode, usable, model) for v, model in made.items()}


def fit_frontier(df: DataFrame, target: str = "class_fills", *, tau: float = 0.8, keep: Sequence[str] | None = None, **options: float) -> Frontier:
    """One of ``fit_frontiers``."""
    return fit_frontiers(df, {"": {"tau": tau, "keep": keep}}, target, **options)[""]


def predict_frontiers(df: DataFrame, made: Mapping[str, Frontier]) -> DataFrame:
    """``npi`` and a column of potential volume for each of ``fit_frontiers``, as its ``predict`` gives it, in one pass over the rows."""
    one, own = next(iter(made.values())), {v: f"__{k}" for k, v in enumerate(made)}
    framed, _ = feature_frame(df)
    rows = one.encoded(framed.select("npi", *one.features, *CATEGORICAL))
    out = boosting.predict(rows.select("npi", "x"), {own[v]: m.model for v, m in made.items()})
    return out.select("npi", *[F.greatest(F.expm1(c), F.lit(0.0)).alias(v) for v, c in own.items()])


def coverage(df: DataFrame, model: Frontier, target: str = "class_fills", slack: float = 0.10) -> DataFrame:
    """Share of in-market rows at or below their frontier, and whether it is off by more than ``slack``."""
    rows, _ = _framed(df, target)
    share = F.avg((F.col("__y") <= F.col("__f") + 1e-9).cast("double"))
    return model.log_potential(rows).agg(F.count("*").alias("n"), share.alias("coverage"), F.lit(model.tau).alias("tau")).withColumn("off", F.abs(F.col("coverage") - F.col("tau")) > slack)


def linear_frontier(df: DataFrame, target: str = "class_fills", envelope: float = 0.95) -> DataFrame:
    """``npi, linear_frontier``: least squares on the numeric features, shifted up to a quantile of its residuals."""
    rows, usable = _framed(df, target)
    x = materialise(VectorAssembler(inputCols=usable, outputCol="x").transform(rows).select("npi", "x", "__y"))
    out = LinearRegression(featuresCol="x", labelCol="__y", predictionCol="__p").fit(x).transform(x)
    shift = out.agg(F.percentile_approx(F.col("__y") - F.col("__p"), envelope, 10_000).alias("__s"))
    return out.join(F.broadcast(shift)).select("npi", F.expm1(F.col("__p") + F.col("__s")).alias("linear_frontier"))  # one row


def permutation_importance(df: DataFrame, model: Frontier, target: str = "class_fills", repeats: int = 3) -> DataFrame:
    """Rise of the pinball loss when a feature comes from another row, mean and deviation over repeats, and its share.

    Donors are matched by global row numbers in key order and in hash order, one scan per repeat. A row meets its donor once:
    the task exchanges the features one by one and hands on sums of losses.
    """
    rows, _ = _framed(df, target)
    names = [*model.features, *CATEGORICAL]
    encoded = materialise(model.encoded(rows).select("npi", vector_to_array("x").alias("x"), "__y"))
    own = ranks.global_scan(encoded, [F.col("npi")], rank="__i")
    parts = []
    for r in range(repeats):
        donors = ranks.global_scan(encoded.select("npi", "x"), [F.xxhash64("npi", F.lit(r)), F.col("npi")], rank="__i").select("__i", F.col("x").alias("d"))
        parts.append(own.join(donors, "__i").select("x", "d", F.col("__y").alias("y"), F.lit(r).alias("repeat")))
    trees, binning, tau = model.model.trees, model.model.binning, model.tau

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, others = (binning.of(boosting.matrix(b.column(c), len(names))) for c in ("x", "d"))
            y, repeat = b.column("y").to_numpy(), b.column("repeat").to_numpy()
            which = np.unique(repeat)
            for name, f in zip(["", *names], itertools.chain([trees.score(bins)], trees.exchanged(bins, others)), strict=True):
                loss = np.maximum(tau * (y - f), (tau - 1) * (y - f))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(which)), pa.array(which, pa.int32()), pa.array([loss[repeat == r].sum() for r in which], pa.float64()), pa.array([(repeat == r).sum() for r in which], pa.int64())], names=["feature", "repeat", "loss", "n"])

    summed = stats.union_all(parts).mapInArrow(losses, "feature string, repeat int, loss double, n long")
    loss = summed.groupBy("feature", "repeat").agg((F.sum("loss") / F.sum("n")).alias("loss"))
    base = loss.where("feature = ''").select("repeat", F.col("loss").alias("base"))
    rise = loss.where("feature <> ''").join(base, "repeat").groupBy("feature").agg(F.avg(F.col("loss") - F.col("base")).alias("importance"), F.stddev_samp(F.col("loss") - F.col("base")).alias("deviation"))
    total = rise.agg(F.sum(F.greatest("importance", F.lit(0.0))).alias("t"))
    return rise.join(F.broadcast(total)).withColumn("share", F.coalesce(F.try_divide(F.greatest("importance", F.lit(0.0)), F.nullif("t", F.lit(0.0))), F.lit(0.0))).drop("t")  # one row


def _fold(key: str, folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")


@dataclass(frozen=True)
class Fit:
    """A mean or, with ``clip``, the probability that the label is 1 inside these bounds; ``on``: condition on training rows; ``weight``: their weight."""

    label: str
    clip: tuple[float, float] | None = None
    on: str = "true"
    weight: str | None = None


def _grown(rows: DataFrame, fits: Mapping[str, Fit], held_out: Mapping[str, int], categorical: Sequence[int], means: Mapping[str, float], chances: Mapping[str, float]) -> dict[str, Boosted | None]:
    """Models of the fits, means and probabilities in a job each; a fit in ``held_out`` isn't trained on that fold."""
    weight = lambda n, f: F.when((F.col("fold") != held_out[n] if n in held_out else F.lit(True)) & F.expr(f.on), F.col(f.weight) if f.weight else F.lit(1.0))
    sides = [({n: Target(f.label, "squared", weight=weight(n, f)) for n, f in fits.items() if f.clip is None}, means), ({n: Target(f.label, "logistic", weight=weight(n, f)) for n, f in fits.items() if f.clip is not None}, chances)]
    made = in_parallel([lambda t=t, o=o: boosting.fit(rows, t, categorical=categorical, **o) for t, o in sides if t])
    return {n: m for part in made for n, m in part.items()}


def _predicted(df: DataFrame, models: Mapping[str, Boosted | None], clips: Mapping[str, tuple[float, float] | None], folds: Mapping[str, int] | None = None) -> DataFrame:
    """A column for each model, null for one without training rows; probabilities inside their bounds."""
    real = {n: m for n, m in models.items() if m is not None}
    out = boosting.predict(df, real, folds=folds) if real else df
    bound = lambda n, c: F.greatest(F.least(F.col(n), F.lit(c[1])), F.lit(c[0]))
    return out.withColumns({n: F.lit(None).cast("double") if m is None else bound(n, clips[n]) if clips[n] else F.col(n) for n, m in models.items()})


def _prepared(df: DataFrame, numeric: Sequence[str], keep: Sequence[str], folds: int, seed: int) -> tuple[DataFrame, list[int]]:
    """``npi``, the kept columns as doubles, the vector ``x`` and the fold, and where ``x`` has categories; rows with a null among them are left out."""
    rows = df.select("npi", *CATEGORICAL, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*numeric, *keep])]).dropna(subset=["npi", *numeric, *keep])
    rows = materialise(rows)
    encoded = encoder(rows, numeric).transform(rows)
    return materialise(encoded.select("npi", "x", *keep, _fold("npi", folds, seed).alias("fold"))), categories_of(numeric)


def cross_fit(rows: DataFrame, fits: Mapping[str, Fit], folds: int, categorical: Sequence[int], means: Mapping[str, float] = MEANS, chances: Mapping[str, float] = CHANCES) -> DataFrame:
    """Add a column for each of ``fits``, predicted by models of the other folds. All folds and fits are grown together."""
    every = {f"__{k}_{n}": (k, n) for k in range(folds) for n in fits}
    made = _grown(rows, {e: fits[n] for e, (_, n) in every.items()}, {e: k for e, (k, _) in every.items()}, categorical, means, chances)
    out = _predicted(rows, made, {e: fits[n].clip for e, (_, n) in every.items()}, {e: k for e, (k, _) in every.items()})
    own = {n: F.element_at(F.array(*[F.col(f"__{k}_{n}") for k in range(folds)]), F.col("fold") + 1) for n in fits}
    return materialise(out.withColumns(own).drop(*every))


def robustness_value(t: Column, dof: Column, critical: float = 0.0) -> Column:
    """Least partial R2 of a confounder with both sides that takes the effect to nothing (or below ``critical``)."""
    f = F.abs(t) / F.sqrt(dof) - (F.lit(critical) / F.sqrt(dof - 1) if critical else F.lit(0.0))
    return F.when(f <= 0, 0.0).otherwise(0.5 * (F.sqrt(F.pow(f, F.lit(4)) + 4 * f * f) - f * f))


def double_ml(df: DataFrame, outcome: str, treatment: str, numeric: Sequence[str], *, binary: bool = False, folds: int = 5, seed: int = 0, **options: float) -> DataFrame:
    """Partially linear effect from cross-fitted residuals: theta, robust error, interval, t and robustness values."""
    rows, categorical = _prepared(df, numeric, [outcome, treatment], folds, seed)
    got = cross_fit(rows, {"__my": Fit(outcome), "__md": Fit(treatment, RESIDUAL_CLIP if binary else None)}, folds, categorical, MEANS | options, CHANCES | options)
    r = got.select((F.col(outcome) - F.col("__my")).alias("ry"), (F.col(treatment) - F.col("__md")).alias("rd"))
    sums = r.agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("rd") * F.col("ry")), F.nullif(F.sum(F.col("rd") * F.col("rd")), F.lit(0.0))).alias("theta"))
    psi = (F.col("ry") - F.col("theta") * F.col("rd")) * F.col("rd")
    out = r.join(F.broadcast(sums)).groupBy("n", "theta").agg(F.avg(psi * psi).alias("p2"), F.avg(F.col("rd") * F.col("rd")).alias("d2"))  # one row
    out = out.withColumn("se", F.sqrt(F.col("p2")) / F.col("d2") / F.sqrt("n")).withColumn("t", F.try_divide("theta", F.nullif("se", F.lit(0.0))))
    return out.select("n", "theta", "se", (F.col("theta") - CRITICAL * F.col("se")).alias("ci_low"), (F.col("theta") + CRITICAL * F.col("se")).alias("ci_high"), "t", robustness_value(F.col("t"), F.col("n") - 1).alias("rv"), robustness_value(F.col("t"), F.col("n") - 1, CRITICAL).alias("rv_alpha"))


def uplift(df: DataFrame, outcome: str, treated: str, numeric: Sequence[str], *, folds: int = 5, seed: int = 0, **options: float) -> DataFrame:
    """``npi, phi, tau``: doubly robust pseudo-outcomes and effects by account, both out of fold."""
    rows, categorical = _prepared(df, numeric, [outcome, treated], folds, seed)
    got = cross_fit(rows, {"e": Fit(treated, UPLIFT_CLIP), "m1": Fit(outcome, on=f"{treated} = 1"), "m0": Fit(outcome, on=f"{treated} = 0")}, folds, categorical, MEANS | options, CHANCES | options)
    t, y, e, m1, m0 = (F.col(c) for c in (treated, outcome, "e", "m1", "m0"))
    got = got.withColumn("phi", m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e))
    edge = got.agg(F.percentile_approx("phi", [0.01, 0.99], 10_000).alias("q"))
    wins = got.join(F.broadcast(edge)).withColumn("__z", F.least(F.greatest("phi", F.col("q")[0]), F.col("q")[1])).select("npi", "x", "fold", "phi", "__z")  # one row
    return cross_fit(wins, {"tau": Fit("__z")}, folds, categorical, MEANS | options).select("npi", "phi", "tau")


def qini(effects: DataFrame, points: int = 40) -> DataFrame:
    """Cumulated pseudo-outcome of the accounts with the highest effects, by fraction, against a random list."""
    scan = ranks.global_scan(effects, [F.col("tau").desc_nulls_last(), F.col("npi")], {"run": F.col("phi")}, total="n").select("rn", "run", "n")
    whole = effects.agg(F.sum("phi").alias("total"), F.count("*").alias("n"))
    cuts = whole.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points)))).withColumn("at", F.when(F.col("g") > 0, F.greatest(F.rint(F.col("g") / points * F.col("n")), F.lit(1.0))).otherwise(0.0).cast("long"))
    hit = F.broadcast(cuts.select("g", "at", "total"))  # a row per point
    return scan.join(hit, F.col("rn") == F.col("at"), "right").select((F.col("g") / points).alias("fraction_targeted"), F.coalesce(F.col("run") / F.col("n"), F.lit(0.0)).alias("uplift_model"), F.coalesce(F.col("g") / points * F.col("total") / F.col("n"), F.lit(0.0)).alias("uplift_random"))


def uplift_deciles(effects: DataFrame) -> DataFrame:
    cut = ranks.decile(effects, "tau", "decile")
    return cut.groupBy("decile").agg(F.avg("tau").alias("predicted"), F.avg("phi").alias("observed"), (F.stddev_samp("phi") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))


def challenger(df: DataFrame, target: str, numeric: Sequence[str], *, folds: int = 5, seed: int = 0, **options: float) -> DataFrame:
    """``npi, predicted``: squared-loss boosting of a growth column, out of fold."""
    rows, categorical = _prepared(df, numeric, [target], folds, seed)
    return cross_fit(rows, {"predicted": Fit(target)}, folds, categorical, FRONTIER | options).select("npi", "predicted")


def tau_sensitivity(df: DataFrame, score: Callable[[DataFrame], DataFrame], taus: Sequence[float], base: float = 0.8, **options: float) -> DataFrame:
    """Rank agreement of opportunities under other quantiles with those under ``base``.

    ``score`` maps predictions (``npi, frontier``) to scored accounts with ``opportunity`` and ``opportunity_decile``.
    """
    predicted = materialise(predict_frontiers(df, fit_frontiers(df, {str(t): {"tau": t} for t in (base, *taus)}, **options)))

    def scored(tau: float) -> DataFrame:
        return materialise(score(predicted.select("npi", F.col(f"`{tau}`").alias("frontier"))).where("in_market").select("npi", "opportunity", "opportunity_decile"))

    def against(first: DataFrame, other: DataFrame, tau: float) -> DataFrame:
        both = first.join(other.select("npi", F.col("opportunity").alias("o"), F.col("opportunity_decile").alias("d")), "npi")
        gap = F.abs(F.col("d") - F.col("opportunity_decile"))
        share = lambda c: F.avg(c.cast("double"))
        kept = F.avg(F.when(F.col("opportunity_decile") >= 8, (F.col("d") >= 8).cast("double")))
        return both.agg(share(gap == 0).alias("same_decile"), share(gap <= 1).alias("within_1"), kept.alias("top3_retained")).join(F.broadcast(backtest.spearman(both, "opportunity", "o"))).withColumn("tau", F.lit(tau))  # one row

    first, *others = in_parallel([lambda t=t: scored(t) for t in (base, *taus)])
    return stats.union_all([against(first, o, t) for o, t in zip(others, taus, strict=True)]).withColumn("holds", (F.col("spearman") >= 0.95) & (F.col("top3_retained") >= 0.90))


#: What the brand-state models see besides the frontier's features.
STATE = ("log_class_fills", "log_brand_fills", "brand_share", "log_potential_gap")


def state_columns(df: DataFrame, more: Iterable[str] = ()) -> DataFrame:
    """``df`` with the key, what states are made of, and ``more``.

    What is written of a wide panel costs by its columns, and past some fifty of them Spark's generated code is too long to be compiled.
    """
    names = dict.fromkeys(["npi", *LOGS.values(), *PLAIN, *CATEGORICAL, "class_fills", "brand_fills", "brand_share", "potential_brand", *more])
    return df.select(*[c for c in names if c in df.columns])


def state_frame(df: DataFrame, extra: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Features of the frontier and of the brand's state, missing shares and extras as 0; and the numeric names."""
    framed, usable = feature_frame(df)
    pos = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    gap = F.col("potential_brand") - F.col("brand_fills") if "potential_brand" in df.columns else F.lit(0.0)
    out = framed.withColumns({"log_class_fills": F.log1p(pos(F.col("class_fills"))), "log_brand_fills": F.log1p(pos(F.col("brand_fills"))), "brand_share": F.coalesce("brand_share", F.lit(0.0)), "log_potential_gap": F.log1p(pos(gap))} | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in extra})
    return out, [*usable, *STATE, *extra]


@dataclass
class StateModel:
    """An encoder of states and fitted models that add columns to encoded rows."""

    encode: PipelineModel
    numeric: list[str]
    extra: tuple[str, ...]
    models: dict[str, Boosted | None]
    clips: dict[str, tuple[float, float] | None]

    def predict(self, df: DataFrame) -> DataFrame:
        """``npi`` and the predictions."""
        return _predicted(encoded_states(df, self.encode, self.numeric, self.extra).select("npi", "x"), self.models, self.clips).drop("x")


def encoded_states(df: DataFrame, encode: PipelineModel, numeric: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``x``, the encoded state; features that were missing when the encoder was made are left out."""
    framed, _ = state_frame(df, extra)
    names = [f"__num_{c}" for c in numeric]
    rows = framed.withColumns({n: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for n, c in zip(names, numeric, strict=True)})
    return encode.transform(rows).drop(*names, *[f"__{c}" for c in CATEGORICAL])


def state_encoder(df: DataFrame, extra: Sequence[str] = ()) -> tuple[PipelineModel, list[str]]:
    framed, numeric = state_frame(df, extra)
    renamed = framed.withColumns({f"__num_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric})
    return encoder(renamed, [f"__num_{c}" for c in numeric]), numeric


def fit_states(train: DataFrame, fits: Mapping[str, Fit], *, extra: Sequence[str] = (), **options: float) -> StateModel:
    """Boosting of columns on the state, all of them together; rows without a label are left out of that model."""
    encode, numeric = state_encoder(train, extra)
    used = dict.fromkeys([*(f.label for f in fits.values()), *(f.weight for f in fits.values() if f.weight)])
    rows = materialise(encoded_states(train, encode, numeric, extra).select("npi", "x", *[F.col(c).cast("double").alias(c) for c in used]))
    made = _grown(rows, fits, {}, categories_of(numeric), MEANS | options, CHANCES | options)
    return StateModel(encode, numeric, tuple(extra), {n: made[n] for n in fits}, {n: f.clip for n, f in fits.items()})
