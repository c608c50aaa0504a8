"""Back-tests on a held-out period, list rules and blends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .opportunity import stack_rules


def holdout_frame(scored: DataFrame, after: DataFrame) -> DataFrame:
    """In-market accounts of the fit period with their outcome in the next one. An undefined share stays undefined."""
    nxt = after.select("npi", *[F.col(c).alias(f"{c}_next") for c in ("class_fills", "brand_fills", "brand_share")])
    out = scored.where("in_market").join(nxt, "npi")
    change = F.col("brand_fills_next") - F.col("brand_fills")
    return out.withColumns({"brand_growth_abs": change, "brand_growth_pct": change / F.greatest(F.col("brand_fills"), F.lit(5.0)), "share_growth": F.col("brand_share_next") - F.col("brand_share"), "flagged": F.col("opportunity_decile") >= 8})


def growth_panel(now: DataFrame, after: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """State at t with the outcome at t + 1; accounts that stop stay, and an undefined share is 0 on both sides."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    nxt = after.select("npi", F.col("brand_fills").alias("brand_fills_next"), F.col("brand_share").alias("brand_share_next"), F.col("class_fills_observed").alias("class_obs_next"))
    out = now.where("class_fills > 0").join(nxt, "npi", "left")
    out = out.withColumns({"growth_abs": zero("brand_fills_next") - F.col("brand_fills"), "growth_share": zero("brand_share_next") - zero("brand_share")})
    if before is not None:
        out = out.join(before.select("npi", F.col("brand_fills").alias("brand_fills_before"), F.col("brand_share").alias("__share_before")), "npi", "left").withColumn("momentum", F.col("brand_fills") - zero("brand_fills_before"))
        out = out.withColumn("prior_growth_share", F.when(F.col("brand_fills_before").isNotNull(), zero("brand_share") - zero("__share_before"))).drop("__share_before")
    return out.withColumn("rural", F.coalesce(F.col("zip3_pop_density") < 100, F.lit(False)))


def decile_lift(hold: DataFrame) -> DataFrame:
    """Growth by decile under both rules."""
    s = stack_rules(hold, {"opportunity": "opportunity_decile", "volume": "volume_decile"}, ["brand_growth_abs", "share_growth"])
    return s.groupBy("rule", F.col("score").cast("int").alias("decile")).agg(F.count("*").alias("n"), F.avg("brand_growth_abs").alias("mean_growth_abs"), F.median("brand_growth_abs").alias("median_growth_abs"), F.sum("brand_growth_abs").alias("total_growth_abs"), F.avg("share_growth").alias("mean_share_growth"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average-tie ranks of rows where both are given."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return ranks.percent_rank(ranks.percent_rank(both, a, "__a"), b, "__b").agg(F.corr("__a", "__b").alias("spearman"))


def head_to_head(hold: DataFrame, share: float = 0.2, rules: dict[str, str] | None = None) -> DataFrame:
    """Growth captured by lists of equal length, and the median base that guards against gaming."""
    n = hold.count()
    k = max(int(share * n), 1)
    totals = hold.agg(F.sum(F.greatest("brand_growth_abs", F.lit(0.0))).alias("ta"), F.sum(F.greatest(F.coalesce("share_growth", F.lit(0.0)), F.lit(0.0))).alias("ts"))
    top = ranks.top_k_by_rule(stack_rules(hold, rules or {"opportunity": "opportunity", "volume": "class_fills"}, ["npi", "brand_growth_abs", "share_growth", "class_fills"]), k)
    got = top.groupBy("rule").agg(F.sum(F.greatest("brand_growth_abs", F.lit(0.0))).alias("growth_captured"), F.sum(F.greatest(F.coalesce("share_growth", F.lit(0.0)), F.lit(0.0))).alias("share_growth_captured"), F.avg("share_growth").alias("mean_share_growth"), F.median("class_fills").alias("median_base_fills"))
    out = got.join(F.broadcast(totals))  # one row
    return out.select("rule", F.lit(k).alias("n_budget"), F.lit(n).alias("universe"), "growth_captured", F.try_divide("growth_captured", "ta").alias("pct_of_growth"), (F.col("growth_captured") / k).alias("growth_per_account"), "share_growth_captured", F.try_divide("share_growth_captured", "ts").alias("pct_of_share_growth"), "mean_share_growth", "median_base_fills")


def stratified_comparison(hold: DataFrame, strata: int = 20, least: int = 5) -> DataFrame:
    """Flagged against other accounts inside volume strata, weighted by the flagged; thin strata are left out."""
    cut = ranks.quantile_cut(hold, "class_fills", "stratum", buckets=strata)
    arm = lambda v, on: F.avg(F.when(F.col("flagged") == on, F.col(v)))
    per = cut.groupBy("stratum").agg(F.count_if("flagged").alias("nt"), F.count_if(~F.col("flagged")).alias("nc"), *[arm(v, on).alias(f"{v}_{int(on)}") for v in ("brand_growth_abs", "share_growth") for on in (True, False)])
    used = per.where((F.col("nt") >= least) & (F.col("nc") >= least))
    weighted = lambda c: F.sum(F.col(c) * F.col("nt")) / F.sum("nt")
    return used.agg(F.count("*").alias("strata"), F.sum("nt").alias("treated"), *[weighted(f"{v}_{i}").alias(f"{v}_{'flagged' if i else 'other'}") for v in ("brand_growth_abs", "share_growth") for i in (1, 0)])


def biggest_misses(hold: DataFrame, n: int = 50) -> DataFrame:
    """The largest growth among accounts that the rule ranked in the lower half."""
    return ranks.top_k(hold.where("opportunity_decile <= 5 and brand_growth_abs > 0"), "brand_growth_abs", n)


def over_represented(part: DataFrame, whole: DataFrame, category: str) -> DataFrame:
    """Difference of the category's shares in a part and in the whole."""
    share = lambda df, name: df.groupBy(category).agg(F.count("*").alias("c")).join(F.broadcast(df.agg(F.count("*").alias("t")))).select(category, (F.col("c") / F.col("t")).alias(name))
    return share(whole, "share_all").join(share(part, "share_part"), category, "left").fillna(0.0, ["share_part"]).withColumn("difference", F.col("share_part") - F.col("share_all"))


def evaluate_rules(panel: DataFrame, rules: dict[str, str], k: int) -> DataFrame:
    """Capture, gains and base of each rule's list of k."""
    s = stack_rules(panel, rules, ["npi", "growth_abs", "growth_share", "class_fills"])
    pos = lambda c: F.greatest(c, F.lit(0.0))
    totals = panel.agg(F.sum(pos(F.col("growth_abs"))).alias("ta"), F.sum(pos(F.col("growth_share"))).alias("ts"))
    got = ranks.top_k_by_rule(s, k).groupBy("rule").agg(F.sum(pos(F.col("growth_abs"))).alias("a"), F.sum(pos(F.col("growth_share"))).alias("s"), F.avg("growth_share").alias("mean_share_growth"), F.avg("class_fills").alias("mean_base"), F.median("class_fills").alias("median_base"), F.sum("class_fills").alias("total_base"), F.sum("growth_abs").alias("net_growth"))
    return got.join(F.broadcast(totals)).select("rule", F.try_divide("a", "ta").alias("abs_capture"), F.try_divide("s", "ts").alias("share_capture"), "mean_share_growth", "mean_base", "median_base", "total_base", "net_growth")


def recommend_rule(table: DataFrame, explainable: Sequence[str], baseline: str = "volume", floor: float = 0.9) -> DataFrame:
    """The explainable rule with the best share capture that keeps ``floor`` of the baseline's absolute capture; else the baseline."""
    base = table.where(F.col("rule") == baseline).select(F.col("abs_capture").alias("b_abs"), F.col("median_base").alias("b_base"))
    t = table.join(F.broadcast(base)).withColumn("clears_floor", F.col("abs_capture") >= floor * F.col("b_abs")).withColumn("metric_gamed", F.col("median_base") < 0.25 * F.col("b_base"))
    choice = t.where(F.col("clears_floor") & F.col("rule").isin(*explainable)).orderBy(F.desc("share_capture"), "rule").limit(1).select(F.col("rule").alias("best"))
    out = t.drop("b_abs", "b_base").join(F.broadcast(choice), how="left")
    return out.withColumn("recommended", F.col("rule") == F.coalesce("best", F.lit(baseline))).drop("best")


def blend_frontier(panel: DataFrame, k: int, weights: Sequence[float], floor: float = 0.9) -> DataFrame:
    """Capture of each blend of opportunity and volume ranks, as ratios to volume alone. Ranks are made once."""
    r = ranks.percent_rank(ranks.percent_rank(panel, "opportunity", "ro"), "class_fills", "rv").select("npi", "ro", "rv", F.greatest("growth_abs", F.lit(0.0)).alias("a"), F.greatest("growth_share", F.lit(0.0)).alias("s"))
    s = r.withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights]))).withColumn("score", F.col("weight") * F.col("ro") + (1 - F.col("weight")) * F.col("rv"))
    got = ranks.top_k_by_rule(s.withColumn("score", F.round("score", 12)), k, rule="weight").groupBy("weight").agg(F.sum("a").alias("a"), F.sum("s").alias("s"))
    base = got.where("weight = 0").select(F.col("a").alias("a0"), F.col("s").alias("s0"))
    return got.join(F.broadcast(base)).select("weight", F.try_divide("a", "a0").alias("abs_ratio"), F.try_divide("s", "s0").alias("share_ratio")).withColumn("clears_floor", F.col("abs_ratio") >= floor)


def choose_weight(frontier: DataFrame) -> DataFrame:
    """The largest share ratio of the weights that clear the floor; volume alone if none does."""
    best = frontier.where("clears_floor").orderBy(F.desc("share_ratio"), "weight").limit(1).select(F.col("weight").alias("w"))
    return best.agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("weight"))


def gates(agreement: DataFrame, lift: DataFrame, heads: DataFrame, territory: DataFrame | None = None) -> DataFrame:
    """Pass or fail of the study's conditions; a missing measurement fails."""
    g2 = agreement.select(F.lit("G2 moves deciles").alias("gate"), (F.col("moved_2_plus") >= 0.30).alias("passed"))
    rho = spearman(lift.where("rule = 'opportunity'"), "decile", "mean_growth_abs").select((F.col("spearman") >= 0.60).alias("passed"))
    o, v = heads.where("rule = 'opportunity'"), heads.where("rule = 'volume'")
    ratio = lambda c: F.try_divide(F.max(f"o.{c}"), F.max(f"v.{c}"))
    both = o.alias("o").join(v.alias("v"), F.col("o.n_budget") == F.col("v.n_budget"))
    g3 = both.agg((ratio("share_growth_captured") >= 1.05).alias("a"), (ratio("median_base_fills") >= 0.25).alias("b"))
    out = g2.unionByName(rho.select(F.lit("G3 ranks growth").alias("gate"), "passed")).unionByName(g3.select(F.lit("G3 beats volume on share").alias("gate"), F.col("a").alias("passed"))).unionByName(g3.select(F.lit("G3 base not gamed").alias("gate"), F.col("b").alias("passed")))
    if territory is None:
        out = out.unionByName(g2.select(F.explode(F.array(F.lit("G4 contiguity"), F.lit("G4 balance"))).alias("gate"), F.lit(None).cast("boolean").alias("passed")))
    else:
        t = territory.agg((F.min("contiguity_rate") >= 0.95).alias("a"), (F.max("workload_cv") <= 0.20).alias("b"))
        out = out.unionByName(t.select(F.lit("G4 contiguity").alias("gate"), F.col("a").alias("passed"))).unionByName(t.select(F.lit("G4 balance").alias("gate"), F.col("b").alias("passed")))
    return out.withColumn("passed", F.coalesce("passed", F.lit(False)))


def gain_curve(df: DataFrame, rules: dict[str, str], value: str, points: int = 38) -> DataFrame:
    """Cumulative share of a value along each rule's ranking, at evenly spaced list lengths.

    Each rule is a global scan of its own, so no rule's rows need one partition.
    """
    total, n = df.agg(F.sum(value), F.count("*")).first()
    out = None
    for rule, column in rules.items():
        scan = ranks.global_scan(df.select("npi", column, value) if column != value else df.select("npi", column), [F.col(column).desc_nulls_last(), F.col("npi")], {"cum": F.col(value)})
        at = scan.join(F.broadcast(scan.sparkSession.range(1, points + 1).select(F.col("id").alias("point"), F.ceil(F.col("id") * n / points).alias("rn"))), "rn")
        part = at.select(F.lit(rule).alias("rule"), "point", (F.col("rn") / n).alias("list_share"), F.try_divide(F.col("cum"), F.lit(total)).alias("captured"))
        out = part if out is None else out.unionByName(part)
    return out
