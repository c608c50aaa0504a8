"""Statistics by aggregation: balance, tests, differences, reliability, drift, shrinkage, errors and calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import erfc, exp, lgamma, log, log1p, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def balance(df: DataFrame, arm: str, covariates: Sequence[str]) -> DataFrame:
    """Standardised mean differences between the arms of a boolean column, pooled over sample variances."""
    long = df.unpivot([arm], list(covariates), "covariate", "v")
    on = lambda f, v: f(F.when(F.col(arm) == v, F.col("v")))
    per = long.groupBy("covariate").agg(on(F.avg, True).alias("mean_treated"), on(F.avg, False).alias("mean_control"), on(F.var_samp, True).alias("vt"), on(F.var_samp, False).alias("vc"))
    return per.select("covariate", "mean_treated", "mean_control", F.try_divide(F.col("mean_treated") - F.col("mean_control"), F.nullif(F.sqrt((F.col("vt") + F.col("vc")) / 2), F.lit(0.0))).alias("smd"))


def welch(df: DataFrame, arm: str, value: str) -> DataFrame:
    """Difference of means with Welch's t and degrees of freedom."""
    on = lambda f, v: f(F.when(F.col(arm) == v, F.col(value)))
    m = df.agg(on(F.avg, True).alias("m1"), on(F.avg, False).alias("m0"), on(F.var_samp, True).alias("v1"), on(F.var_samp, False).alias("v0"), on(F.count, True).alias("n1"), on(F.count, False).alias("n0"))
    m = m.withColumn("a", F.col("v1") / F.col("n1")).withColumn("b", F.col("v0") / F.col("n0"))
    dof = F.pow(F.col("a") + F.col("b"), 2) / (F.pow("a", F.lit(2)) / (F.col("n1") - 1) + F.pow("b", F.lit(2)) / (F.col("n0") - 1))
    return m.select((F.col("m1") - F.col("m0")).alias("difference"), F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(F.col("a") + F.col("b"))).alias("t"), dof.alias("dof"), "n1", "n0")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), 1e-300)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def student_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function; null stays null."""

    @F.pandas_udf("double")
    def cdf(values: pd.Series) -> pd.Series:
        return values.map(lambda v: 0.5 * erfc(-v / sqrt(2)), na_action="ignore").astype("float64")

    return cdf(x)


def p_value(t: Column, dof: Column) -> Column:
    """Two-sided p-values of Student's t as a column; null if either is null."""

    @F.pandas_udf("double")
    def p(ts: pd.Series, dofs: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else student_p(a, b) for a, b in zip(ts, dofs, strict=True)], dtype="float64")

    return p(t, dof)


def did(df: DataFrame, arm: str, pre: str, post: str) -> DataFrame:
    """Difference in differences of two-period outcomes."""
    change = F.col(post) - F.col(pre)
    on = lambda v: F.avg(F.when(F.col(arm) == v, change))
    return df.agg(on(True).alias("treated_change"), on(False).alias("control_change"), (on(True) - on(False)).alias("did"))


def did_cluster_bootstrap(df: DataFrame, arm: str, change: str, cluster: str, reps: int = 200, seed: int = 11) -> DataFrame:
    """Estimate and standard error by resampling whole clusters, on their sums: rows are aggregated once before the draws."""
    sums = df.groupBy(cluster).agg(*[f.alias(n) for v, s in ((True, "1"), (False, "0")) for f, n in ((F.sum(F.when(F.col(arm) == v, F.col(change)).otherwise(0.0)), f"s{s}"), (F.count_if(F.col(arm) == v), f"n{s}"))])
    draws = sums.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    w = F.when(F.col("rep") == 0, F.lit(1)).otherwise(poisson_weight(F.xxhash64(cluster, "rep", F.lit(seed))))
    mean = lambda s: F.try_divide(F.sum(F.col(f"s{s}") * w), F.sum(F.col(f"n{s}") * w))
    est = draws.groupBy("rep").agg((mean(1) - mean(0)).alias("did"))
    return est.agg(F.max(F.when(F.col("rep") == 0, F.col("did"))).alias("did"), F.stddev_samp(F.when(F.col("rep") > 0, F.col("did"))).alias("se"))


def poisson_weight(h: F.Column) -> F.Column:
    """A Poisson(1) count from a 64-bit hash, by its inverse distribution function."""
    u = F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))
    total, term, chain = 0.0, 0.36787944117144233, None
    for k in range(8):
        total += term
        chain = F.when(u < total, F.lit(k)) if chain is None else chain.when(u < total, F.lit(k))
        term /= k + 1
    return chain.otherwise(F.lit(8))


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    """Slope, intercept and standard error of a simple regression, from one aggregation."""
    m = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.count("*").alias("n"))
    sse = F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    given = lambda c: F.when(F.col("sxx") > 0, c)  # noqa: E731  a constant regressor has no slope
    return m.select(given(F.col("slope")).alias("slope"), given(F.col("intercept")).alias("intercept"), given(F.sqrt(F.greatest(F.try_divide(sse, (F.col("n") - 2) * F.col("sxx")), F.lit(0.0)))).alias("se"), "n")


def icc(df: DataFrame, group: str, value: str, *, floored: bool = False) -> DataFrame:
    """One-way intraclass correlation over groups of at least two, with the group-size correction.

    ``floored``: at least 0, and 0 where fewer than three groups are left or the variances vanish.
    """
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v")).where("n > 1")
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"))
    t = t.withColumn("msb", F.try_divide(F.col("nmm") - F.try_divide(F.col("nm") * F.col("nm"), F.col("N")), F.col("k") - 1)).withColumn("msw", F.try_divide(F.col("ssw"), F.col("N") - F.col("k"))).withColumn("n0", F.try_divide(F.col("N") - F.try_divide(F.col("nn"), F.col("N")), F.col("k") - 1))
    ratio = F.try_divide(F.col("msb") - F.col("msw"), F.col("msb") + (F.col("n0") - 1) * F.col("msw"))
    if floored:
        ratio = F.when((F.col("k") >= 3) & (ratio > 0), ratio).otherwise(0.0)
    return t.select("k", "N", ratio.alias("icc"))


def psi_numeric(before: DataFrame, after: DataFrame, column: str, floor: float = 1e-4) -> DataFrame:
    """Population stability index over the deciles of the earlier period, with open ends."""
    edges = before.agg(F.percentile(column, F.array(*[F.lit(k / 10) for k in range(1, 10)])).alias("edges"))
    bucket = F.size(F.filter("edges", lambda e: e <= F.col(column)))
    share = lambda df, name: df.where(F.col(column).isNotNull()).join(F.broadcast(edges)).groupBy(bucket.alias("b")).agg(F.count("*").alias("c")).withColumn(name, F.col("c") / F.sum("c").over(Window.partitionBy())).drop("c")  # noqa: E731  at most ten rows
    return _psi(share(before, "pe"), share(after, "pa"), floor)


def psi_categorical(before: DataFrame, after: DataFrame, column: str, floor: float = 1e-4) -> DataFrame:
    share = lambda df, name: df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("b")).agg(F.count("*").alias("c")).withColumn(name, F.col("c") / F.sum("c").over(Window.partitionBy())).drop("c")  # noqa: E731  a row per category
    return _psi(share(before, "pe"), share(after, "pa"), floor)


def _psi(e: DataFrame, a: DataFrame, floor: float) -> DataFrame:
    both = e.join(a, "b", "full_outer")
    x, y = (F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(floor)) for c in ("pa", "pe"))
    return both.agg(F.sum((x - y) * F.log(x / y)).alias("psi"))


def ks(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic over counted distinct values, by a global scan."""
    both = before.select(F.col(column).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(after.select(F.col(column).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where("v is not null")
    counted = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    scan = ranks.global_scan(counted, [F.col("v").asc()], {"fa": F.col("a"), "fb": F.col("b")}, rank=None)
    n = counted.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return scan.join(F.broadcast(n)).agg(F.max(F.abs(F.col("fa") / F.col("na") - F.col("fb") / F.col("nb"))).alias("ks"))


def beta_prior(df: DataFrame, group: str, hits: str, trials: str, least: int = 20, few: int = 30) -> DataFrame:
    """Beta prior of a rate by group, by moments weighted by trials: ``mean, strength, a, b, accounts``.

    Rows of at least ``least`` trials count, or all with a trial where fewer than ``few`` have them. The binomial noise of
    the rates is taken off their variance. A group without trials has no prior.
    """
    rows = df.select(group, F.greatest(F.col(trials).cast("double"), F.lit(0.0)).alias("n"), F.greatest(F.col(hits).cast("double"), F.lit(0.0)).alias("y"))
    large = F.col("n") >= least

    def sums(on: Column, name: str) -> list[Column]:
        """Weight, weighted rates and their squares, and rows: p times n is y, its square times n is y * y / n."""
        return [F.sum(F.when(on, x)).alias(f"{name}_{k}") for k, x in (("w", F.col("n")), ("y", F.col("y")), ("yy", F.try_divide(F.col("y") * F.col("y"), F.nullif(F.col("n"), F.lit(0.0)))), ("k", F.lit(1)))]

    m = rows.groupBy(group).agg(F.count("*").alias("accounts"), *sums(large, "l"), *sums(F.col("n") > 0, "a"))
    pick = lambda c: F.when(F.coalesce("l_k", F.lit(0)) < few, F.col(f"a_{c}")).otherwise(F.col(f"l_{c}"))
    m = m.withColumns({c: pick(c) for c in ("w", "y", "yy", "k")}).where("k > 0").withColumn("m", F.col("y") / F.col("w"))
    spread = F.col("m") * (1 - F.col("m"))
    real = F.greatest(F.col("yy") / F.col("w") - F.col("m") * F.col("m") - spread * F.col("k") / F.col("w"), F.lit(1e-6))
    mean, strength = F.least(F.greatest("m", F.lit(1e-4)), F.lit(1 - 1e-4)), F.least(F.greatest(spread / real - 1, F.lit(1.0)), F.lit(5000.0))
    return m.select(group, mean.alias("mean"), strength.alias("strength"), (mean * strength).alias("a"), ((1 - mean) * strength).alias("b"), "accounts")


def shrink(df: DataFrame, priors: DataFrame, group: str, hits: str, trials: str, name: str = "eb_share") -> DataFrame:
    """Empirical-Bayes rate (hits + a) / (trials + a + b), hits at most trials; a group without a prior takes the median prior.

    The priors are a row per group.
    """
    middle = priors.agg(F.median("a").alias("__a"), F.median("b").alias("__b"))
    mine = priors.select(F.col(group).alias("__g"), F.col("a").alias("__pa"), F.col("b").alias("__pb"))
    out = df.join(mine, df[group].eqNullSafe(F.col("__g")), "left").join(F.broadcast(middle))  # one row
    a, b = F.coalesce("__pa", "__a"), F.coalesce("__pb", "__b")
    n = F.greatest(F.coalesce(F.col(trials).cast("double"), F.lit(0.0)), F.lit(0.0))
    y = F.least(F.greatest(F.coalesce(F.col(hits).cast("double"), F.lit(0.0)), F.lit(0.0)), n)
    return out.withColumn(name, (y + a) / (n + a + b)).drop("__g", "__pa", "__pb", "__a", "__b")


def shrunk_growth(panel: DataFrame, priors: DataFrame, group: str = "specialty_group") -> DataFrame:
    """Shrunk share now and in the next period, its change ``eb_growth_share``, and the change in volume ``eb_share_fills``, which is the target aligned with value."""
    out = shrink(panel, priors, group, "brand_fills", "class_fills_observed")
    out = shrink(out, priors, group, "brand_fills_next", "class_obs_next", "eb_share_next")
    out = out.withColumn("eb_growth_share", F.col("eb_share_next") - F.col("eb_share"))
    return out.withColumn("eb_share_fills", F.col("eb_growth_share") * F.greatest("class_fills", F.lit(0.0)))


def stack_segments(df: DataFrame, segments: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per row and segment; a row once more under all."""
    pairs = F.explode(F.array(F.struct(F.lit("all").alias("segment"), F.lit("all").alias("level")), *[F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("level")) for s in segments]))
    return df.select(*keep, pairs.alias("x")).select(*keep, "x.segment", "x.level")


def segment_errors(df: DataFrame, segments: Sequence[str], predicted: str, actual: str, least: int = 200) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    g = stack_segments(df, segments, [predicted, actual]).groupBy("segment", "level").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.try_divide(F.sum(e), F.sum(actual)).alias("relative_bias"))
    return g.where(F.col("n") >= least)


def representation(df: DataFrame, segments: Sequence[str], listed: str, value: str) -> DataFrame:
    """Share of the list over share of the value, by segment level."""
    g = stack_segments(df, segments, [listed, value]).groupBy("segment", "level").agg(F.count_if(listed).alias("l"), F.sum(value).alias("v"))
    t = df.agg(F.count_if(listed).alias("tl"), F.sum(value).alias("tv"))
    return g.join(F.broadcast(t)).select("segment", "level", F.try_divide("l", "tl").alias("list_share"), F.try_divide("v", "tv").alias("value_share"), F.try_divide(F.try_divide("l", "tl"), F.try_divide("v", "tv")).alias("ratio"))


def coverage(df: DataFrame, segments: Sequence[str], low: str, high: str, actual: str, least: int = 200) -> DataFrame:
    inside = F.col(actual).between(F.col(low), F.col(high)).cast("double")
    g = stack_segments(df, segments, [low, high, actual]).groupBy("segment", "level").agg(F.count("*").alias("n"), F.avg(inside).alias("coverage"), F.median(F.col(high) - F.col(low)).alias("median_width"))
    return g.where(F.col("n") >= least)


def calibration(df: DataFrame, predicted: str, actual: str, key: str = "npi") -> DataFrame:
    cut = ranks.quantile_cut(df.select(key, predicted, actual), predicted, "bin", key)
    return cut.groupBy("bin").agg(F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("mean_actual"), F.count("*").alias("n"))


def leave_one_out(links: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Mean of the other members' values of each group, averaged over an account's groups. Groups of one have none."""
    m = links.join(values.select("npi", value), "npi").where(F.col(value).isNotNull())
    g = m.groupBy("practice").agg(F.sum(value).alias("s"), F.count("*").alias("n")).where("n > 1")
    return m.join(g, "practice").groupBy("npi").agg(F.avg((F.col("s") - F.col(value)) / (F.col("n") - 1)).alias("peer_mean"), F.count("*").alias("practices"))


def histogram(df: DataFrame, value: str, arm: str, bins: int = 20) -> DataFrame:
    """Counts of a score in [0, 1] by bin and arm."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count_if(F.col(arm)).alias("treated"), F.count_if(~F.col(arm)).alias("control"))


def captured_headroom(panel: DataFrame, now: str = "brand_share", after: str = "brand_share_next") -> DataFrame:
    """Add ``captured``: growth of the share over what was left to win (at least 0.01), within -1 and 1; an undefined share is 0."""
    share, growth = F.coalesce(F.col(now), F.lit(0.0)), F.coalesce(F.col(after), F.lit(0.0)) - F.coalesce(F.col(now), F.lit(0.0))
    return panel.withColumn("captured", F.greatest(F.least(growth / F.greatest(1 - share, F.lit(0.01)), F.lit(1.0)), F.lit(-1.0)))


def dose_response(panel: DataFrame, least: int = 200) -> DataFrame:
    """Captured headroom by number of calls over the zero-call mean of the volume decile, pooled by size.

    Cells of fewer than ``least`` accounts are left out, and deciles with too few accounts without calls; the level of no
    calls is 0 by construction and stays.
    """
    cell = panel.groupBy("vol_decile", "calls").agg(F.count("*").alias("n"), F.avg("captured").alias("m")).where(F.col("n") >= least)
    base = cell.where("calls = 0").select("vol_decile", F.col("m").alias("m0"))
    over = cell.join(base, "vol_decile")
    return over.groupBy("calls").agg((F.sum((F.col("m") - F.col("m0")) * F.col("n")) / F.sum("n")).alias("captured_excess"), F.sum("n").alias("n"))


def ranked_metrics(df: DataFrame, score: str, k: int, values: Sequence[str], relevance: str, key: str = "npi") -> DataFrame:
    """Capture of each value, precision against the top decile of relevance, and NDCG of a list of k."""
    base = df.withColumn("__rel", F.greatest(F.coalesce(F.col(relevance), F.lit(0.0)), F.lit(0.0)))
    n = base.count()
    listed = ranks.global_scan(ranks.top_k(base, score, k, key), [F.col(score).desc_nulls_last(), F.col(key)])
    best = ranks.global_scan(ranks.top_k(base.select(key, "__rel"), "__rel", k, key), [F.col("__rel").desc(), F.col(key)])
    gain = lambda frame: frame.agg(F.sum(F.col("__rel") / F.log2(F.col("rn") + 1.0)))
    tenth = ranks.top_k(base.select(key, "__rel"), "__rel", max(1, n // 10), key).select(key, F.lit(1).alias("__top"))
    got = listed.join(tenth, key, "left").agg(*[F.sum(F.greatest(F.col(v), F.lit(0.0))).alias(f"g_{v}") for v in values], F.avg(F.coalesce("__top", F.lit(0))).alias("precision"), F.median("class_fills").alias("median_base"))
    whole = base.agg(*[F.sum(F.greatest(F.col(v), F.lit(0.0))).alias(f"t_{v}") for v in values])
    ndcg = gain(listed).toDF("dcg").join(F.broadcast(gain(best).toDF("ideal"))).select(F.try_divide("dcg", "ideal").alias("ndcg"))
    return got.join(F.broadcast(whole)).join(F.broadcast(ndcg)).select(*[F.try_divide(f"g_{v}", f"t_{v}").alias(f"{v}_capture") for v in values], "precision", "ndcg", "median_base")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def list_uplift(effects: DataFrame, rules: Mapping[str, str], k: int) -> DataFrame:
    """Sums of effects and of their pseudo-outcomes over each rule's list of ``k``, and the list's length."""
    from .opportunity import stack_rules

    rows = effects.select("npi", *dict.fromkeys(rules.values()), F.col("tau").alias("__tau"), F.col("phi").alias("__phi"))
    top = ranks.top_k_by_rule(stack_rules(rows, rules, ["npi", "__tau", "__phi"]), k)
    return top.groupBy("rule").agg(F.sum("__tau").alias("uplift"), F.sum("__phi").alias("observed"), F.count("*").alias("listed"))
