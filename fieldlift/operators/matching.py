"""Propensity matching, saturating response curves by profile fits, falsification tests and pilot power."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import written as materialise
from . import models, ranks, resample, stats

CALIPER = 0.2


def logistic(rows: DataFrame, label: str, covariates: Sequence[str], penalty: float = 1.0, iterations: int = 50) -> Column:
    """Log odds of a 0/1 label as a column over standardised covariates, with a ridge penalty on their weights.

    Newton's method: a step is one aggregation of the gradient and the curvature, (p + 1)(p + 4) / 2 sums of one row, until the weights move by less than
    1e-9. A constant covariate weighs nothing; with labels of one kind the odds are 50 or -50, without rows null.
    """
    label_ = F.col(label).cast("double")
    first = rows.agg(F.count("*"), F.avg(label_), *[f(F.col(c).cast("double")) for c in covariates for f in (F.avg, F.stddev_pop)]).first()
    if not first[0]:
        return F.lit(None).cast("double")
    if first[1] in (0.0, 1.0):  # all of one kind
        return F.lit(50.0 if first[1] else -50.0)
    mean, spread = first[2::2], first[3::2]
    z = [F.lit(1.0), *[(F.col(c).cast("double") - F.lit(m)) / F.lit(s) if s else F.lit(0.0) for c, m, s in zip(covariates, mean, spread, strict=True)]]
    share = min(max(first[1], 1e-6), 1 - 1e-6)
    w = np.array([np.log(share / (1 - share)), *[0.0] * len(covariates)])
    ridge = np.diag([1e-9, *[penalty] * len(covariates)])
    odds = lambda w: sum((F.lit(float(a)) * x for a, x in zip(w[1:], z[1:], strict=True)), F.lit(float(w[0])))
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    for _ in range(iterations):
        p = 1 / (1 + F.exp(-odds(w)))
        out = rows.select(*[x.alias(f"z{k}") for k, x in enumerate(z)], label_.alias("y"), p.alias("p"))
        sums = out.agg(*[F.sum(F.col(f"z{k}") * (F.col("y") - F.col("p"))) for k in range(len(z))], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}") * F.col("p") * (1 - F.col("p"))) for i, j in pairs]).first()
        curve = ridge.copy()
        for (i, j), v in zip(pairs, sums[len(z) :], strict=True):
            curve[i, j] += v
            if i != j:
                curve[j, i] += v
        step = np.linalg.solve(curve, np.array(sums[: len(z)]) - np.array([0.0, *[penalty] * len(covariates)]) * w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return odds(w)


def propensity(df: DataFrame, treated: str, covariates: Sequence[str]) -> DataFrame:
    """Rows without missing covariates with ``logit``, the log odds of treatment by logistic regression on standardised covariates."""
    rows = materialise(df.dropna(subset=[treated, *covariates]))
    edge = float(np.log((1 - 1e-6) / 1e-6))
    return rows.withColumn("logit", F.greatest(F.least(logistic(rows, treated, covariates), F.lit(edge)), F.lit(-edge)))


def match(scored: DataFrame, treated: str, caliper: float = CALIPER, key: str = "npi") -> DataFrame:
    """``treated_npi, control_npi, distance``: one control for a treated account within ``caliper`` standard deviations of ``logit``.

    In a round every treated account asks two free controls, one below and one above it in the order of the logit, and takes
    its wish to the nearer; a control takes the nearest that asks. The accounts of a run without a control inside ask different ones:
    the lowest the first control below the run, the next one the second, and likewise from above, so that a run (of copies,
    or where nearly all are treated) is served in one round and not one account a round. Rounds go on while one makes a
    pair: the ends of a run ask their neighbours, so no treated account with a free control in reach is left. No account is
    used twice, and no pairs of all with all are made.
    """
    left = materialise(scored.select(key, F.col(treated).cast("boolean").alias("t"), "logit"))
    reach = (left.agg(F.stddev_samp("logit")).first()[0] or 0.0) * caliper
    found = None
    while True:
        scan = materialise(ranks.global_scan(left, [F.col("logit"), F.col("t"), F.col(key)], {"c": (~F.col("t")).cast("double"), "n": F.col("t").cast("double")}, rank=None))
        controls = scan.where(~F.col("t")).select(F.col("c").alias("at"), F.col(key).alias("control"), F.col("logit").alias("other"))
        # A run is what lies behind the same control; its accounts are numbered from both of its ends.
        runs = scan.where("t").groupBy("c").agg(F.min("n").alias("first"), F.max("n").alias("last"))
        asks = scan.where("t").join(runs, "c").select(F.col(key).alias("account"), "logit", F.explode(F.array(F.col("c") - (F.col("n") - F.col("first")), F.col("c") + 1 + (F.col("last") - F.col("n")))).alias("at"))
        near = asks.join(controls, "at").withColumn("distance", F.abs(F.col("logit") - F.col("other"))).where(F.col("distance") <= reach)
        wish = near.groupBy("account").agg(F.min(F.struct("distance", "control")).alias("w")).select("account", "w.distance", "w.control")
        pairs = materialise(wish.groupBy("control").agg(F.min(F.struct("distance", "account")).alias("w")).select(F.col("w.account").alias(f"treated_{key}"), F.col("control").alias(f"control_{key}"), F.col("w.distance").alias("distance")))
        if pairs.isEmpty():
            return pairs if found is None else found
        found = pairs if found is None else materialise(found.unionByName(pairs))
        used = pairs.select(F.explode(F.array(f"treated_{key}", f"control_{key}")).alias(key))
        left = materialise(left.join(used, key, "left_anti"))


def matched_rows(df: DataFrame, pairs: DataFrame, key: str = "npi") -> DataFrame:
    return df.join(pairs.select(F.explode(F.array(f"treated_{key}", f"control_{key}")).alias(key)), key, "left_semi")


def matched_balance(scored: DataFrame, pairs: DataFrame, treated: str, covariates: Sequence[str], threshold: float = 0.10) -> DataFrame:
    """``covariate, smd_before, smd_after, balanced``."""
    before = stats.balance(scored, treated, covariates).select("covariate", F.col("smd").alias("smd_before"))
    after = stats.balance(matched_rows(scored, pairs), treated, covariates).select("covariate", F.col("smd").alias("smd_after"))
    return before.join(after, "covariate", "left").withColumn("balanced", F.coalesce(F.abs("smd_after") < threshold, F.lit(False)))


def paired_difference(df: DataFrame, pairs: DataFrame, value: str, key: str = "npi") -> DataFrame:
    """Mean difference over pairs with its error and interval, the means of both sides and their ratio."""
    side = lambda name: df.select(F.col(key).alias(f"{name}_{key}"), F.col(value).alias(name))
    both = pairs.join(side("treated"), f"treated_{key}").join(side("control"), f"control_{key}").withColumn("d", F.col("treated") - F.col("control"))
    out = both.agg(F.count("d").alias("pairs"), F.avg("treated").alias("treated_mean"), F.avg("control").alias("control_mean"), F.avg("d").alias("difference"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("se"))
    return out.withColumn("ratio", F.when(F.col("control_mean") > 0, F.col("treated_mean") / F.col("control_mean"))).withColumn("ci_low", F.col("difference") - 1.96 * F.col("se")).withColumn("ci_high", F.col("difference") + 1.96 * F.col("se"))


# Saturating curves


def profile_fit(points: DataFrame, halves: Sequence[float] | Column, by: Sequence[str] = ("rep",), most: float = 1.0) -> DataFrame:
    """Least squares of y = ceiling * x / (half + x) by group: ``ceiling, half, sse, n``.

    ``points``: the group, x, y and a weight w. For a given half-saturation the ceiling is a ratio of sums, clipped to
    0..``most``, and so is the error: one aggregation evaluates all of the ``halves``, and the best of them is taken.
    """
    grid = F.array(*[F.lit(float(h)) for h in halves]) if not isinstance(halves, Column) else halves
    yy = F.sum(F.col("w") * F.col("y") * F.col("y"))
    sums = points.withColumn("__h", F.explode(grid)).withColumn("__g", F.col("x") / (F.col("__h") + F.col("x")))
    sums = sums.groupBy(*by, "__h").agg(F.sum(F.col("w") * F.col("y") * F.col("__g")).alias("yg"), F.sum(F.col("w") * F.col("__g") * F.col("__g")).alias("gg"), yy.alias("yy"), F.sum("w").alias("n"))
    ceiling = F.least(F.greatest(F.coalesce(F.try_divide("yg", F.nullif("gg", F.lit(0.0))), F.lit(0.0)), F.lit(0.0)), F.lit(most))
    sums = sums.withColumn("ceiling", ceiling).withColumn("sse", F.col("yy") - 2 * F.col("ceiling") * F.col("yg") + F.col("ceiling") * F.col("ceiling") * F.col("gg"))
    best = F.min(F.struct("sse", "__h", "ceiling", "n")).alias("b")
    return sums.groupBy(*by).agg(best).select(*by, "b.ceiling", F.col("b.__h").alias("half"), "b.sse", "b.n")


def saturation(df: DataFrame, amount: str, response: str, *, reps: int = 200, grid: int = 60, points: int = 80, least: int = 50, seed: int = 21) -> tuple[DataFrame, DataFrame]:
    """Saturating response to an amount: one row of verdict, and the curve with its bootstrap band.

    The verdict is refused, without a half-saturation and with an empty curve, where fewer than ``least`` rows or no amounts
    are given, where the ceiling is nothing, and where the curve would bend beyond the largest amount.
    """
    rows = df.where(F.col(amount) >= 0).select("npi", F.col(amount).cast("double").alias("x"), F.col(response).cast("double").alias("y")).dropna()
    rows = materialise(rows)
    n, top, high = rows.agg(F.count("*"), F.max("x"), F.percentile_approx("x", 0.99, 10_000)).first()
    spark = df.sparkSession
    verdict = "identifiable boolean, reason string, ceiling double, ceiling_low double, ceiling_high double, half double, ninety_percent double"
    curve = "amount double, predicted double, low double, high double"
    refuse = lambda why, c=None: (spark.createDataFrame([(False, why, c, None, None, None, None)], verdict), spark.createDataFrame([], curve))
    if n < least or not top:
        return refuse("too few rows or no amounts")
    halves = [top * 10 ** (-3 + 6 * k / (grid - 1)) for k in range(grid)]
    draws = resample.drawn(rows, reps, seed).withColumn("w", F.col("m").cast("double"))
    fits = materialise(profile_fit(draws.select("rep", "x", "y", "w"), halves))
    own = fits.where("rep = 0").first()
    if own["ceiling"] <= 1e-4:
        return refuse("no positive response", own["ceiling"])
    if own["half"] > top:
        return refuse("half-saturation outside the observed range", own["ceiling"])
    out = fits.agg(F.lit(True).alias("identifiable"), F.lit(None).cast("string").alias("reason"), *resample.interval("ceiling"), F.max(F.when(F.col("rep") == 0, F.col("half"))).alias("half")).withColumn("ninety_percent", 9 * F.col("half"))
    at = fits.withColumn("amount", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k * F.lit(high / (points - 1)))))
    at = at.withColumn("v", F.col("ceiling") * F.col("amount") / (F.col("half") + F.col("amount")))
    band = at.groupBy("amount").agg(*resample.interval("v", "predicted")).withColumnsRenamed({"predicted_low": "low", "predicted_high": "high"})
    return out, band.select("amount", "predicted", "low", "high")


def dose_fit(panel: DataFrame, *, reps: int = 200, least: int = 200, grid: int = 60, seed: int = 23) -> DataFrame:
    """Saturating fit of the dose-response curve over draws of accounts: one row with intervals, weighted R2 and whether it is identified.

    ``panel``: npi, vol_decile, calls, captured. Every draw makes its own curve. A fit at a bound, or one that explains no more
    than the mean, isn't a measurement. With fewer than four levels nothing is fitted.
    """
    cells = resample.drawn(panel.select("npi", "vol_decile", "calls", "captured"), reps, seed).groupBy("rep", "vol_decile", "calls").agg(F.sum("m").alias("n"), (F.sum(F.col("m") * F.col("captured")) / F.sum("m")).alias("c")).where(F.col("n") >= least)
    cells = materialise(cells)
    base = cells.where("calls = 0").select("rep", "vol_decile", F.col("c").alias("c0"))
    pooled = cells.join(base, ["rep", "vol_decile"]).groupBy("rep", F.col("calls").cast("double").alias("x")).agg((F.sum((F.col("c") - F.col("c0")) * F.col("n")) / F.sum("n")).alias("y"), F.sum("n").cast("double").alias("w"))
    pooled = materialise(pooled.withColumn("levels", F.count("*").over(Window.partitionBy("rep"))).where("levels >= 4"))  # a row per number of calls
    halves = [0.5 * 120 ** (k / (grid - 1)) for k in range(grid)]
    fits = profile_fit(pooled, halves)
    mean = pooled.groupBy("rep").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("syy"), F.count("*").alias("levels"))
    fits = materialise(fits.join(mean, "rep").withColumn("r2", 1 - F.try_divide("sse", F.nullif(F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw"), F.lit(0.0)))))
    zero = lambda c: F.max(F.when(F.col("rep") == 0, F.col(c))).alias(c)
    out = fits.agg(*resample.interval("ceiling"), *resample.interval("half"), zero("r2"), zero("levels"), F.count_if(F.col("rep") > 0).alias("draws"))
    return out.withColumn("fitted", F.col("ceiling").isNotNull()).withColumn("identifiable", F.coalesce((F.col("ceiling") > 1e-4) & (F.col("half") < 59.9) & (F.col("r2") > 0), F.lit(False)))


# Falsification


def falsification(df: DataFrame, outcome: str, before: str, treated: str, unrelated: str, doses: str, numeric: Sequence[str], *, bands: Sequence[tuple[str, int, int]] = (("1", 1, 1), ("2-3", 2, 3), ("4+", 4, 1 << 30)), reps: int = 200, least: int = 200, stratum: str = "specialty_group", seed: int = 3, **options: float) -> DataFrame:
    """Tests that could show the effect of ``treated`` on ``outcome`` to be something else: a row each with its estimate and verdict.

    A treatment that can't matter (``unrelated``, the real one held fixed), shuffles of the flag inside strata, effects by
    dose, and the outcome of the period before. The negative control passes if it isn't significant, and partly if it is
    less than half of the effect.
    """
    rows = materialise(df)
    flag = lambda c: (F.coalesce(F.col(c), F.lit(0)) > 0).cast("double")
    effect = lambda d, y, t, x, s: models.double_ml(d, y, t, x, binary=True, seed=s, **options)
    tests = {"main estimate": (rows, outcome, treated, numeric, 0), "negative control": (rows.withColumn("__other", flag(unrelated)), outcome, "__other", [*numeric, treated], 3), "period before": (rows, before, treated, [c for c in numeric if c != before], 5)}
    sizes = {name: rows.where(F.col(doses).between(low, high)).count() for name, low, high in bands}
    for name, low, high in bands:
        if sizes[name] >= least:
            part = rows.where((F.coalesce(F.col(doses), F.lit(0)) == 0) | F.col(doses).between(low, high)).withColumn("__dose", flag(doses))
            tests[f"dose {name}"] = (part, outcome, "__dose", numeric, 4)
    got = stats.union_all([effect(*t).select(F.lit(name).alias("test"), "theta", "se", "ci_low", "ci_high", "t") for name, t in tests.items()])
    got = materialise(got)
    main = got.where("test = 'main estimate'").select(F.abs("theta").alias("size"))
    shuffle = resample.permutation_test(rows, stratum, treated, outcome, reps=reps, seed=seed).select(F.lit("shuffles inside strata").alias("test"), F.col("slope").alias("theta"), "p_value")
    out = got.withColumn("p_value", F.lit(None).cast("double")).unionByName(shuffle, allowMissingColumns=True).join(F.broadcast(main))  # one row
    insignificant = F.abs("t") <= 1.96
    grade = F.when(F.col("test") == "negative control", F.when(insignificant, "pass").when(F.abs("theta") < 0.5 * F.col("size"), "partial").otherwise("fail"))
    grade = grade.when(F.col("test") == "shuffles inside strata", F.when(F.col("p_value") < 0.05, "pass").otherwise("fail")).when(F.col("test") == "period before", F.when(insignificant, "pass").otherwise("fail"))
    return out.withColumn("grade", grade).drop("size")


# Pilot


def pilot_inputs(listed: DataFrame, ceiling: float, calls: float, half: float, territory: str = "territory") -> DataFrame:
    """By endpoint: break-even effect of a listed account, winsorised deviation, correlation with the year before, territory ICC, list and territory sizes.

    ``listed``: opportunity, class_fills, growth_share, growth_abs, those of the year before (``prior_...``) and the territory.
    The effect is what calling has to win for the force to pay; a share endpoint divides it by the account's volume.
    """
    won = ceiling * F.greatest("opportunity", F.lit(0.0)) * calls / (half + calls)
    rows = materialise(listed.select(territory, F.explode(F.array(F.struct(F.lit("share").alias("endpoint"), (won / F.greatest("class_fills", F.lit(1.0))).alias("effect"), F.col("growth_share").alias("g"), F.col("prior_growth_share").alias("p")), F.struct(F.lit("fills").alias("endpoint"), won.alias("effect"), F.col("growth_abs").alias("g"), F.col("prior_growth_abs").alias("p")))).alias("e")).select(territory, "e.*"))
    edges = rows.groupBy("endpoint").agg(F.percentile("g", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    cut = lambda c: F.least(F.greatest(F.col(c), F.col("q")[0]), F.col("q")[1])
    wins = materialise(rows.join(F.broadcast(edges), "endpoint").withColumns({"g": cut("g"), "p": F.when(F.col("p").isNotNull(), cut("p"))}))  # two rows
    both = F.col("g").isNotNull() & F.col("p").isNotNull()
    g, p = (F.when(both, F.col(c)) for c in ("g", "p"))
    # ``corr`` raises where one side doesn't vary.
    corr = F.try_divide(F.covar_pop(g, p), F.sqrt(F.var_pop(g) * F.var_pop(p)))
    rho = F.when(F.count_if(both) > 30, F.greatest(F.coalesce(corr, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    base = wins.groupBy("endpoint").agg(F.avg("effect").alias("effect"), F.stddev_samp("g").alias("sd"), rho.alias("rho"), F.count("*").alias("listed"), F.count_distinct(territory).alias("territories"))
    icc = stats.union_all([stats.icc(wins.where(F.col("endpoint") == e), territory, "g", floored=True).select(F.lit(e).alias("endpoint"), "icc") for e in ("share", "fills")])
    return base.join(F.broadcast(icc), "endpoint")  # two rows


def power(effect: Column, sd: Column, treated: Column, control: Column, design: Column | None = None, z: float = 1.959964) -> Column:
    """Power of a two-sided z-test of a mean difference between arms of given sizes."""
    error = sd * F.sqrt((design if design is not None else F.lit(1.0)) * (1 / F.greatest(treated, F.lit(1.0)) + 1 / F.greatest(control, F.lit(1.0))))
    return stats.normal_cdf(F.try_divide(effect, F.nullif(error, F.lit(0.0))) - z)


def pilot_power(inputs: DataFrame, months: Sequence[int] = (6, 12), hold_out: float = 0.2, wanted: float = 0.8) -> DataFrame:
    """By endpoint and duration: power with accounts held out, with territories split, and the least held-out share for the wanted power.

    The effect grows with time and the noise with its root; the year before takes its correlation's part off the variance.
    """
    grid = inputs.withColumn("months", F.explode(F.array(*[F.lit(m) for m in months])))
    grid = grid.withColumns({"d": F.col("effect") * F.col("months") / 12, "s": F.col("sd") * F.sqrt(F.col("months") / 12) * F.sqrt(F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(0.0))), "per": F.col("listed") / F.greatest("territories", F.lit(1))})
    arm = F.floor(F.col("territories") / 2) * F.col("per")
    out = grid.withColumn("power_hold_out", power(F.col("d"), F.col("s"), F.col("listed") * (1 - hold_out), F.col("listed") * hold_out))
    out = out.withColumn("power_territories", power(F.col("d"), F.col("s"), arm, arm, 1 + (F.col("per") - 1) * F.col("icc")))
    shares = grid.withColumn("share", F.explode(F.array(*[F.lit(k / 100) for k in range(5, 51)]))).withColumn("p", power(F.col("d"), F.col("s"), F.col("listed") * (1 - F.col("share")), F.col("listed") * F.col("share")))
    least = shares.where(F.col("p") >= wanted).groupBy("endpoint", "months").agg(F.min("share").alias("hold_out_needed"))
    return out.join(least, ["endpoint", "months"], "left").select("endpoint", "months", "power_hold_out", "power_territories", "hold_out_needed")
