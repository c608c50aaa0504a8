"""Call plans, force sizing, sensitivity, value of re-targeting, pay-off and regret.

The plan is ranked once; every size and scenario is then an expression over the stored running sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import decile_band, desired_calls, hill, share_band
from . import ranks

#: Base, low and high of each economic assumption.
ECONOMICS = {
    "rep_cost_annual": (250_000.0, 200_000.0, 300_000.0),
    "calls_per_rep_per_day": (8.0, 6.0, 10.0),
    "selling_days_per_month": (20.0, 18.0, 21.0),
    "net_revenue_per_30day_fill": (380.0, 300.0, 450.0),
    "contribution_margin": (0.87, 0.80, 0.92),
    "call_response_ceiling": (0.28, 0.15, 0.40),
    "call_response_half_saturation": (12.0, 6.0, 24.0),
}
REPS = range(30, 701, 10)
CURRENT_REPS = 60


def base_case(**changes: float) -> dict[str, float]:
    return {k: v[0] for k, v in ECONOMICS.items()} | changes


def monthly_capacity(reps: float, e: Mapping[str, float] | None = None) -> float:
    e = e or base_case()
    return reps * e["calls_per_rep_per_day"] * e["selling_days_per_month"]


def call_plan(scored: DataFrame, capacity: float) -> DataFrame:
    """Call frequency from the matrix, filled from the top of the opportunity ranking until the monthly capacity is used."""
    wanted = F.when(F.col("in_market"), desired_calls(F.col("opportunity_decile"), F.col("brand_share"))).otherwise(0.0)
    out = scored.withColumns({"decile_band": decile_band(F.col("opportunity_decile")), "share_band": share_band(F.col("brand_share")), "desired_calls": wanted})
    scan = ranks.global_scan(out.select("npi", "opportunity", "desired_calls"), [F.col("opportunity").desc(), F.col("npi")], {"cumulative": F.col("desired_calls")}, rank=None)
    out = out.join(scan.select("npi", "cumulative"), "npi")
    out = out.withColumn("calls_per_month", F.when(F.col("cumulative") <= capacity, F.col("desired_calls")).otherwise(0.0)).drop("cumulative")
    return out.withColumn("calls_per_year", F.col("calls_per_month") * 12).withColumn("is_target", F.col("calls_per_month") > 0)


def matrix_summary(plan: DataFrame) -> DataFrame:
    """The complete band grid, empty cells included."""
    spark = plan.sparkSession
    grid = spark.createDataFrame([(d, s) for d in ("Decile 9-10", "Decile 7-8", "Decile 1-6") for s in ("Low (<20%)", "Mid (20-50%)", "High (>50%)")], "decile_band string, share_band string")
    got = plan.groupBy("decile_band", "share_band").agg(F.count("*").alias("accounts"), F.count_if("is_target").alias("targets"), F.sum("calls_per_month").alias("calls"), F.sum("opportunity").alias("opportunity"))
    return grid.join(got, ["decile_band", "share_band"], "left").fillna(0)


def plan_summary(plan: DataFrame, reps: int) -> DataFrame:
    capacity = monthly_capacity(reps)
    return plan.agg(F.count_if(F.col("desired_calls") > 0).alias("wanted"), F.count_if("is_target").alias("targets"), F.sum("calls_per_month").alias("calls"), F.sum("desired_calls").alias("demand")).select(
        "wanted", "targets", F.try_divide("targets", "wanted").alias("served"), (F.col("calls") / capacity).alias("utilisation"), "demand", (F.col("demand") / monthly_capacity(1)).alias("implied_reps")
    )


def reach_at_budget(plan: DataFrame, rules: Mapping[str, str], capacity: float) -> DataFrame:
    """Opportunity that each rule's list of affordable length reaches."""
    row = plan.where("desired_calls > 0").agg(F.avg("desired_calls"), F.count("*")).first()
    k = int(capacity / row[0]) if row[0] else 0
    from .opportunity import stack_rules

    inside = plan.where("in_market")
    top = ranks.top_k_by_rule(stack_rules(inside, rules, ["npi", "opportunity"]), k)
    total = inside.agg(F.sum("opportunity").alias("t"), F.count("*").alias("n"))
    got = top.groupBy("rule").agg(F.sum("opportunity").alias("o")).join(F.broadcast(total))
    return got.select("rule", F.lit(k).alias("k"), F.try_divide("o", "t").alias("reach"), (F.lit(k) >= F.col("n")).alias("vacuous"))


def allocation(plan: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Annual calls wanted in opportunity order, with their running sum; rows without calls are left out."""
    wanted = 12 * F.col("desired_calls") if wanted is None else wanted
    rows = plan.select("npi", "opportunity", wanted.cast("double").alias("wanted")).where("wanted > 0")
    return ranks.global_scan(rows, [F.col("opportunity").desc(), F.col("npi")], {"cum": F.col("wanted")}, rank=None)


def evaluate(ranked: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Economics of each scenario: columns of ``ECONOMICS``, n_reps and scenario. The account at the boundary is served in part.

    ``scenarios`` is a small grid; each account meets it in a broadcast and is summed at once.
    """
    capacity = F.col("n_reps") * F.col("calls_per_rep_per_day") * F.col("selling_days_per_month") * 12
    got = F.when(F.col("cum") <= F.col("capacity"), F.col("wanted")).otherwise(F.greatest(F.col("capacity") - (F.col("cum") - F.col("wanted")), F.lit(0.0)))
    rows = ranked.join(F.broadcast(scenarios.withColumn("capacity", capacity))).withColumn("calls", got)
    sums = rows.groupBy("scenario", "n_reps").agg(
        F.first("capacity").alias("annual_call_capacity"), F.sum("calls").alias("calls_allocated"), F.count_if(F.col("calls") > 0).alias("accounts_reached"),
        F.sum(F.col("opportunity") * hill(F.col("calls"), F.col("call_response_ceiling"), F.col("call_response_half_saturation"))).alias("incremental_fills"),
        *[F.first(c).alias(c) for c in ("net_revenue_per_30day_fill", "contribution_margin", "rep_cost_annual", "call_response_ceiling")],
    )
    out = sums.withColumn("contribution", F.col("incremental_fills") * F.col("net_revenue_per_30day_fill") * F.col("contribution_margin")).withColumn("field_cost", F.col("n_reps") * F.col("rep_cost_annual"))
    return out.withColumn("profit", F.col("contribution") - F.col("field_cost")).withColumn("roi", F.try_divide("contribution", "field_cost"))


def grid(spark, scenarios: Mapping[str, Mapping[str, float]], reps: Sequence[int] = REPS) -> DataFrame:
    names = list(ECONOMICS)
    rows = [(name, float(n), *[e[k] for k in names]) for name, e in scenarios.items() for n in reps]
    return spark.createDataFrame(rows, "scenario string, n_reps double, " + ", ".join(f"{k} double" for k in names))


def roi_curve(evaluated: DataFrame) -> DataFrame:
    """Marginal contribution per rep, and its return on a rep's cost."""
    w = Window.partitionBy("scenario").orderBy("n_reps")
    step = F.col("n_reps") - F.lag("n_reps").over(w)
    out = evaluated.withColumn("marginal_contribution", (F.col("contribution") - F.lag("contribution").over(w)) / step)
    return out.withColumn("marginal_roi", F.col("marginal_contribution") / F.col("rep_cost_annual"))


def break_even(curve: DataFrame) -> DataFrame:
    """Where the marginal return falls below one, interpolated between grid points; the end of the grid if it never does."""
    w = Window.partitionBy("scenario").orderBy("n_reps")
    c = curve.where("marginal_roi is not null").withColumns({"pn": F.lag("n_reps").over(w), "pm": F.lag("marginal_roi").over(w)})
    at = F.when(F.col("pn").isNull() | (F.col("pm") == F.col("marginal_roi")), F.col("n_reps")).otherwise(F.col("pn") + (F.col("pm") - 1) / (F.col("pm") - F.col("marginal_roi")) * (F.col("n_reps") - F.col("pn")))
    per = c.groupBy("scenario").agg(F.max("n_reps").alias("top"), F.min_by(F.when(F.col("marginal_roi") < 1, at), F.when(F.col("marginal_roi") < 1, F.col("n_reps"))).alias("x"))
    return per.select("scenario", F.coalesce("x", "top").alias("break_even_reps"))


def tornado(ranked: DataFrame, reps: Sequence[int] = REPS) -> DataFrame:
    """Break-even at the low and high value of each assumption, by swing; all scenarios in one job."""
    spark = ranked.sparkSession
    cases = {"base": base_case()} | {f"{k}:{side}": base_case(**{k: v[i]}) for k, v in ECONOMICS.items() for i, side in ((1, "low"), (2, "high"))}
    b = break_even(roi_curve(evaluate(ranked, grid(spark, cases, reps)))).withColumn("assumption", F.split_part("scenario", F.lit(":"), F.lit(1))).withColumn("side", F.split_part("scenario", F.lit(":"), F.lit(2)))
    per = b.where("side <> ''").groupBy("assumption").agg(F.max(F.when(F.col("side") == "low", F.col("break_even_reps"))).alias("at_low"), F.max(F.when(F.col("side") == "high", F.col("break_even_reps"))).alias("at_high"))
    return per.withColumn("swing", F.abs(F.col("at_high") - F.col("at_low")))


def required_ceiling(curve: DataFrame) -> DataFrame:
    """The response at which the last step of reps pays: contribution is linear in the ceiling. Null if it takes more than all."""
    need = F.try_divide(F.col("rep_cost_annual") * F.col("call_response_ceiling"), F.col("marginal_contribution"))
    return curve.where("marginal_contribution is not null").select("scenario", "n_reps", F.when(need <= 1, need).alias("required_ceiling"))


def sizing_summary(curve: DataFrame, swings: DataFrame, current: int = CURRENT_REPS, *, identified: bool = True, expansion: float = 1.5, demand: DataFrame | None = None) -> DataFrame:
    """Break-even, the recommendation within the plausible expansion, and the range over all assumptions; where the response isn't identified the size is held.

    ``demand``: the plan, whose desired calls beyond the current capacity are the unmet share.
    """
    b = break_even(curve.where("scenario = 'base'"))
    top = swings.agg(F.min(F.least("at_low", "at_high")).alias("lowest"), F.max(F.greatest("at_low", "at_high")).alias("highest"))
    advice = F.least(F.col("break_even_reps"), F.lit(expansion * current)) if identified else F.lit(float(current))
    out = b.join(F.broadcast(top)).select("break_even_reps", advice.alias("recommended_reps"), "lowest", "highest")
    if demand is None:
        return out
    unmet = demand.agg(F.greatest(1 - F.try_divide(F.lit(monthly_capacity(current)), F.nullif(F.sum("desired_calls"), F.lit(0.0))), F.lit(0.0)).alias("unmet_share"))
    return out.join(F.broadcast(unmet))  # one row


def retargeting_value(scored: DataFrame, rules: Mapping[str, str], k: int, calls: float, e: Mapping[str, float] | None = None) -> DataFrame:
    """Captured fills and contribution of equal lists and frequencies under each rule."""
    e = e or base_case()
    from .opportunity import stack_rules

    top = ranks.top_k_by_rule(stack_rules(scored.where("in_market"), rules, ["npi", "opportunity"]), k)
    rate = e["call_response_ceiling"] * calls / (e["call_response_half_saturation"] + calls)
    return top.groupBy("rule").agg((F.sum("opportunity") * rate).alias("fills")).withColumn("contribution", F.col("fills") * e["net_revenue_per_30day_fill"] * e["contribution_margin"])


def payoff(curve: DataFrame, decisions: Sequence[int], ceilings: Mapping[str, float], current: int = CURRENT_REPS, hire: float = 60_000.0, release: float = 50_000.0, ramp_months: float = 6.0) -> DataFrame:
    """Pay-off and regret of each force size under each response scenario, with switching costs and ramp-up."""
    spark = curve.sparkSession
    base = curve.where(F.col("n_reps").isin(*[float(n) for n in decisions])).select("n_reps", "contribution", "field_cost", "call_response_ceiling")
    now = curve.where(F.col("n_reps") == float(current)).select(F.col("contribution").alias("c0"))
    s = spark.createDataFrame([(k, float(v)) for k, v in ceilings.items()], "response string, ceiling double")
    rows = base.join(F.broadcast(now)).join(F.broadcast(s)).withColumn("scale", F.col("ceiling") / F.col("call_response_ceiling"))
    added = F.greatest(F.col("n_reps") - current, F.lit(0.0))
    switching = hire * added + release * F.greatest(current - F.col("n_reps"), F.lit(0.0))
    lost = F.greatest(F.col("contribution") - F.col("c0"), F.lit(0.0)) * F.col("scale") * (ramp_months / 12 / 2)
    out = rows.withColumn("payoff", F.col("contribution") * F.col("scale") - F.col("field_cost") - switching - lost)
    w = Window.partitionBy("response")
    return out.select("n_reps", "response", "payoff", (F.max("payoff").over(w) - F.col("payoff")).alias("regret"))


def minimax(payoffs: DataFrame) -> DataFrame:
    return payoffs.groupBy("n_reps").agg(F.max("regret").alias("worst_regret"), F.min("payoff").alias("worst_payoff")).withColumn("chosen", F.row_number().over(Window.orderBy("worst_regret", "n_reps")) == 1)


def hold_out_cost(plan: DataFrame, listed: int, share: float = 0.2) -> DataFrame:
    """One row: the part of the list's contribution that holding a share of it out costs.

    The calls of those held out go to the next accounts below the list, so the loss is the gap to these.
    """
    held = round(share * listed)
    first = ranks.top_k(plan.select("npi", "opportunity"), "opportunity", listed).agg(F.avg("opportunity").alias("on_list"))
    wider = ranks.top_k(plan.select("npi", "opportunity"), "opportunity", listed + held).agg(F.sum("opportunity").alias("s"), F.count("*").alias("n"))
    rest = F.try_divide(F.col("s") - F.col("on_list") * listed, F.col("n") - listed)
    gap = F.greatest(1 - F.try_divide(rest, F.col("on_list")), F.lit(0.0))
    return first.join(F.broadcast(wider)).select(F.when(F.col("on_list") > 0, share * gap).otherwise(share).alias("cost_fraction"))  # one row


def grow_threshold(curve: DataFrame, target: float, required: float, current: float = CURRENT_REPS, horizon: float = 3.0, hire: float = 60_000.0, ramp_months: float = 6.0) -> DataFrame:
    """One row: the response, as a multiple of the required one and at least 1, above which growing to ``target`` reps pays over the horizon.

    The value is linear in the response, so it is a ratio; null if more reps add nothing.
    """
    at = lambda n, c: F.max(F.when(F.col("n_reps") == float(n), F.col(c)))
    per = F.col("contribution") / F.col("call_response_ceiling")
    rows = curve.where(F.col("scenario") == "base").withColumn("k", per)
    d = rows.agg((at(target, "k") - at(current, "k")).alias("k"), (at(target, "field_cost") - at(current, "field_cost")).alias("cost"))
    need = F.try_divide(horizon * F.col("cost") + hire * (target - current), F.when(F.col("k") > 0, F.col("k") * (horizon - ramp_months / 24)))
    return d.select(F.greatest(need / required, F.when(need.isNotNull(), F.lit(1.0))).alias("times_required"))
