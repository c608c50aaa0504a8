"""Queries of forecasts, attributions, matching, saturation, segments, ladders, networks and pilots over the bound tables.

Where SQL can't express a model, the tests hold it against known answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.session import materialise
from ..operators import backtest as B
from ..operators import blends, evaluate, explain, forecast, market, matching, models, reads, segments, sizing, stats, territory
from ..operators import opportunity as O
from ..operators import ranks as R
from . import fixture as T
from .core import PANEL, WEIGHTS, _panel
from .modelled import _uplift
from .registry import query
from .study import CAPACITY, LINKS, VALUE, _cohort, dose_panel, train_priors, value_panel

Spark = SparkSession
BUDGET = 150


def train_panel(s: Spark, d: str) -> DataFrame:
    """State of the period before the fit period with the fit period's outcome, and the shrunk changes."""
    m = T.mart(s, d)
    return stats.shrunk_growth(B.growth_panel(T.scored(s, d, 1998), m.where("year = 1999")), train_priors(s, d))


def _fit_rows(s: Spark, d: str) -> DataFrame:
    return materialise(T.mart(s, d).where(F.col("year") == T.FIT))


# Forecasts

SCORES = "scores AS (SELECT npi, CASE WHEN class_fills < 50 THEN '<50' WHEN class_fills < 200 THEN '50-199' WHEN class_fills < 800 THEN '200-799' ELSE '800+' END AS size_band, greatest(ln(1 + brand_fills / 2) - ln(1 + brand_fills_next), ln(1 + brand_fills_next) - ln(1 + brand_fills * 1.5 + 10)) AS score FROM hold WHERE brand_fills_next > 0)"


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY size_band ORDER BY score, npi) AS p, count(*) OVER (PARTITION BY size_band) AS n FROM scores) SELECT size_band, n, score AS qhat FROM r WHERE p = ceil(round(least(ceil((n + 1) * 0.9) / n, 1) * (n - 1), 9)) + 1", "qhat")
def ev6_qhat_by_band(s: Spark, d: str) -> DataFrame:
    """The conformal constant by size band, of half and one and a half times this period's volume as the interval."""
    log = lambda c: F.log1p(c)
    h = T.holdout(s, d).where("brand_fills_next > 0").withColumns({"size_band": X.size_band(F.col("class_fills")), "lo": log(F.col("brand_fills") / 2), "hi": log(F.col("brand_fills") * 1.5 + 10), "y": log("brand_fills_next")})
    return forecast.qhat(h.withColumn("score", forecast.conformity("lo", "hi", "y")), "score", by="size_band")


@query(None)
def ev6_conformal_coverage(s: Spark, d: str) -> DataFrame:
    return forecast.interval_coverage(train_panel(s, d), value_panel(s, d))


@query(None)
def ev7_hurdle(s: Spark, d: str) -> DataFrame:
    return forecast.hurdle(train_panel(s, d), value_panel(s, d))


@query(None)
def ev7_hurdle_calibration(s: Spark, d: str) -> DataFrame:
    return forecast.hurdle_calibration(train_panel(s, d), value_panel(s, d))


def _forecast(s: Spark, d: str) -> DataFrame:
    return forecast.forecast(value_panel(s, d), T.scored(s, d, T.HOLDOUT).where("in_market"))


@query(None)
def ev8_forecast(s: Spark, d: str) -> DataFrame:
    return _forecast(s, d)


@query(None)
def ev9_poisson_calibration(s: Spark, d: str) -> DataFrame:
    after = materialise(models.state_columns(value_panel(s, d), ["brand_fills_next"]))
    predicted = forecast.poisson_counts(train_panel(s, d), after)
    return stats.calibration(materialise(predicted.join(after.select("npi", F.coalesce("brand_fills_next", F.lit(0.0)).alias("actual")), "npi")), "predicted", "actual")


# Attribution


@query(None)
def d17_top_drivers(s: Spark, d: str) -> DataFrame:
    m = _fit_rows(s, d)
    return explain.top_drivers(explain.attribution(m.where("class_fills > 0"), models.fit_frontier(m)))


@query(None)
def d18_fidelity(s: Spark, d: str) -> DataFrame:
    m = _fit_rows(s, d)
    model = models.fit_frontier(m)
    return explain.fidelity(m.where("class_fills > 0"), model, materialise(models.permutation_importance(m, model)))


@query(None)
def d16_ablation(s: Spark, d: str) -> DataFrame:
    practice, local = ("log_panel_benes", "log_non_class_clms", "risk_score"), ("log_zip3_population", "log_pop_density")
    variants = {"production": {}, "no practice features": {"keep": local}, "no local-market features": {"keep": practice}, "no specialty": {"flatten": ("specialty_group",)}, "no region": {"flatten": ("region",)}, "median, not frontier": {"tau": 0.5}, "national share": {"national": True}}
    return explain.ablation(_fit_rows(s, d), materialise(market.peer_benchmark(T.mart(s, d))), value_panel(s, d), BUDGET, variants)


@query("""SELECT npi, CASE WHEN m > 1 AND non_class_clms < 500 THEN 'specialised practice: only ' || format('{:,}', round_even(non_class_clms, 0)::BIGINT) || ' claims outside the class' ELSE 'non_class_clms: ' || format('{:,}', round_even(non_class_clms, 0)::BIGINT) END || printf(' (x%.2f potential)', m) AS volume,
 'risk_score: ' || printf('%.2f', risk_score + 0.00003) || printf(' (x%.2f potential)', m) AS risk, 'region: ' || region || printf(' (x%.2f potential)', m) AS place FROM (SELECT *, CASE WHEN npi % 2 = 0 THEN 1.5 ELSE 0.75 END AS m FROM scored WHERE in_market)""")
def pr19_reasons(s: Spark, d: str) -> DataFrame:
    times = F.when(F.col("npi") % 2 == 0, 1.5).otherwise(0.75)
    said = lambda f, v: X.reason_text(F.lit(f), v, times)
    return T.scored(s, d).where("in_market").select("npi", said("log_non_class_clms", F.log1p("non_class_clms")).alias("volume"), said("risk_score", F.col("risk_score") + 0.00003).alias("risk"), said("region", F.col("region")).alias("place"))


@query(None)
def j13_rq4_full_call_list(s: Spark, d: str) -> DataFrame:
    """A territory's visiting order with each account's first driver and its forecast."""
    p = materialise(sizing.call_plan(T.scored(s, d), CAPACITY))
    rows = _fit_rows(s, d).where("class_fills > 0")
    drivers = materialise(explain.top_drivers(explain.attribution(rows, models.fit_frontier(rows)), 1))
    framed, usable = O.feature_frame(rows)
    value = F.coalesce(*[F.when(F.col("feature") == c, F.col(c).cast("string")) for c in (*usable, *O.CATEGORICAL)])
    drivers = drivers.join(framed.select("npi", *usable, *O.CATEGORICAL), "npi").select("npi", "rank", "feature", "multiplier", value.alias("value"))
    out = reads.call_list(p, territory.baseline(territory.units(p), 5), 2, drivers, _forecast(s, d))
    return out.select("npi", "territory", "is_target", "opportunity", "visit_order", "why", "lo", "median", "hi", "p_active")


@query(None)
def rq2_full_account_detail(s: Spark, d: str) -> DataFrame:
    """The first account of the list with its trend, payments, segment, drivers, forecast and effect of a touch."""
    sc, pay, m = materialise(T.scored(s, d)), materialise(T.payments(s, d)), _fit_rows(s, d)
    npi = R.top_k(sc.where("in_market").join(pay, "npi", "left_semi"), "opportunity", 1).first()["npi"]
    drivers = explain.top_drivers(explain.attribution(m.where("class_fills > 0"), models.fit_frontier(m))).select("npi", "rank", "feature", "multiplier")
    clustered = segments.clusters(segments.standardised(_segment_panel(s, d)), 5).select("npi", "cluster")
    more = {"segment": clustered, "drivers": drivers, "forecast": _forecast(s, d), "effect": _uplift(s, d).select("npi", "tau")}
    return reads.detail(sc, T.mart(s, d), npi, pay, **more).select("npi", "opportunity", "trend", "payments", *more)


# Matching and response

MATCHED = ["log_fills", "risk"]


def _matched(s: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    c = materialise(matching.propensity(_cohort(s, d), "treated", MATCHED))
    return c, materialise(matching.match(c, "treated"))


@query(None)
def j12_matched_pairs(s: Spark, d: str) -> DataFrame:
    return _matched(s, d)[1]


@query(None)
def rs6_matched_balance(s: Spark, d: str) -> DataFrame:
    c, pairs = _matched(s, d)
    return matching.matched_balance(c, pairs, "treated", MATCHED)


@query(None)
def rs6_flagged_difference(s: Spark, d: str) -> DataFrame:
    """Growth of the flagged against accounts of the same propensity to be flagged."""
    h = T.holdout(s, d).withColumns({"log_class_fills": F.log1p("class_fills"), "log_panel_benes": F.log1p("panel_benes"), "log_non_class_clms": F.log1p("non_class_clms"), "share": F.coalesce("brand_share", F.lit(0.0))})
    c = materialise(matching.propensity(h, "flagged", ["log_class_fills", "log_panel_benes", "log_non_class_clms", "share", "risk_score"]))
    return matching.paired_difference(c, matching.match(c, "flagged"), "brand_growth_abs")


@query(None)
def rs10_did_matched(s: Spark, d: str) -> DataFrame:
    c, pairs = _matched(s, d)
    return stats.did(matching.matched_rows(c, pairs), "treated", "share_pre", "share_post")


@query(None)
def rs11_saturation(s: Spark, d: str) -> DataFrame:
    c, pairs = _matched(s, d)
    return matching.saturation(matching.matched_rows(c, pairs), "paid", "post_delta")[0]


@query(None)
def rs13_dose_fit(s: Spark, d: str) -> DataFrame:
    return matching.dose_fit(dose_panel(s, d))


COVARIATES = ["log_panel_benes", "log_non_class_clms", "risk_score", "class_fills", "brand_fills", "prior_growth_share"]


@query(None)
def rs16_falsification(s: Spark, d: str) -> DataFrame:
    """Effect of focus touches on the shrunk change of share; the negative control is touches that name neither brand."""
    pay = T.payments(s, d).where(F.col("year") == T.FIT).select("npi", "focus_events", (F.col("pay_count") - F.col("focus_events") - F.col("competitor_events")).alias("other_events"))
    framed, _ = O.feature_frame(value_panel(s, d))
    rows = framed.join(pay, "npi", "left").fillna(0, ["focus_events", "other_events"]).fillna(0.0, ["prior_growth_share"]).withColumn("treated", (F.col("focus_events") > 0).cast("double"))
    return matching.falsification(rows, "eb_growth_share", "prior_growth_share", "treated", "other_events", "focus_events", COVARIATES)


def _pilot(s: Spark, d: str) -> DataFrame:
    p = materialise(value_panel(s, d))
    before = train_panel(s, d).select("npi", F.col("growth_share").alias("prior_share"), F.col("growth_abs").alias("prior_abs"))
    hybrid = R.percent_rank(R.percent_rank(p, "opportunity", "ro"), "class_fills", "rv").withColumn("score", F.round((F.col("ro") + F.col("rv")) / 2, 12))
    listed = R.top_k(hybrid, "score", BUDGET).drop("prior_growth_share").join(before.withColumnsRenamed({"prior_share": "prior_growth_share", "prior_abs": "prior_growth_abs"}), "npi", "left")
    return matching.pilot_inputs(materialise(listed), 0.2, 12.0, 12.0, "zip3")


@query(f"""WITH {PANEL}, h AS (SELECT p.*, o.growth_share AS ps, o.growth_abs AS pa, (rank() OVER (ORDER BY opportunity) + (count(*) OVER (PARTITION BY opportunity) - 1) / 2) / count(*) OVER () AS ro, (rank() OVER (ORDER BY class_fills) + (count(*) OVER (PARTITION BY class_fills) - 1) / 2) / count(*) OVER () AS rv
 FROM panel p LEFT JOIN (SELECT a.npi, coalesce(b.brand_share, 0) - coalesce(a.brand_share, 0) AS growth_share, coalesce(b.brand_fills, 0) - a.brand_fills AS growth_abs FROM mart a LEFT JOIN mart b ON b.npi = a.npi AND b.year = 1999 WHERE a.year = 1998 AND a.class_fills > 0) o ON o.npi = p.npi),
l AS (SELECT *, 0.2 * opportunity * 12 / 24 AS won FROM h ORDER BY round((ro + rv) / 2, 12) DESC, npi LIMIT {BUDGET}),
e AS (SELECT 'share' AS endpoint, zip3, won / greatest(class_fills, 1) AS effect, growth_share AS g, ps AS p FROM l UNION ALL SELECT 'fills', zip3, won, growth_abs, pa FROM l),
w AS (SELECT endpoint, zip3, effect, least(greatest(g, lo), hi) AS g, CASE WHEN p IS NOT NULL THEN least(greatest(p, lo), hi) END AS p FROM e JOIN (SELECT endpoint, quantile_cont(g, 0.01) AS lo, quantile_cont(g, 0.99) AS hi FROM e GROUP BY 1) USING (endpoint)),
z AS (SELECT *, avg(g) OVER (PARTITION BY endpoint, zip3) AS m FROM w QUALIFY count(*) OVER (PARTITION BY endpoint, zip3) > 1), zz AS (SELECT *, avg(g) OVER (PARTITION BY endpoint) AS grand FROM z),
c AS (SELECT endpoint, zip3, count(*) AS n, any_value(m) AS m, any_value(grand) AS grand, sum((g - m) ** 2) AS inside FROM zz GROUP BY ALL),
i AS (SELECT endpoint, count(*) AS k, sum(n * (m - grand) ** 2) / (count(*) - 1) AS b, sum(inside) / (sum(n) - count(*)) AS s, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS n0 FROM c GROUP BY 1)
SELECT w.endpoint, avg(effect) AS effect, stddev_samp(g) AS sd, CASE WHEN count(p) > 30 THEN greatest(coalesce(corr(g, p), 0), 0) ELSE 0 END AS rho, count(*) AS listed, count(DISTINCT zip3) AS territories, any_value(CASE WHEN k >= 3 THEN greatest((b - s) / (b + (n0 - 1) * s), 0) ELSE 0 END) AS icc FROM w JOIN i USING (endpoint) GROUP BY 1""", "effect sd rho icc")
def rs19_pilot_inputs(s: Spark, d: str) -> DataFrame:
    return _pilot(s, d)


@query(None)
def rs19_u3_pilot_power(s: Spark, d: str) -> DataFrame:
    return matching.pilot_power(_pilot(s, d))


# Ladders, ceilings, networks


@query(None)
def ev2_rule_ladder(s: Spark, d: str) -> DataFrame:
    panel, rules = evaluate.ladder_panel(train_panel(s, d), value_panel(s, d))
    return evaluate.ladder(panel, rules, BUDGET)


@query(f"""WITH {PANEL}, {VALUE}, r AS (SELECT rule, v.*, row_number() OVER (PARTITION BY rule ORDER BY CASE rule WHEN 'volume' THEN class_fills ELSE opportunity END DESC, npi) AS p FROM val v, (VALUES ('volume'), ('frontier')) t(rule)),
i AS (SELECT sum(g / log2(k + 1)) AS ideal FROM (SELECT greatest(eb_share_fills, 0) AS g, row_number() OVER (ORDER BY greatest(eb_share_fills, 0) DESC, npi) AS k FROM val) WHERE k <= {BUDGET}),
t AS (SELECT sum(greatest(eb_share_fills, 0)) AS tv, sum(greatest(growth_abs, 0)) AS ta, sum(greatest(eb_growth_share, 0)) AS te, list_sort(list(eb_share_fills))[ceil(0.9 * count(*))::INT] AS cut FROM val)
SELECT rule, sum(greatest(eb_share_fills, 0)) / any_value(tv) AS value_capture, sum(greatest(growth_abs, 0)) / any_value(ta) AS abs_capture, sum(greatest(eb_growth_share, 0)) / any_value(te) AS eb_share_capture, avg((eb_share_fills >= cut)::INT) AS precision_at_k, sum(greatest(eb_share_fills, 0) / log2(p + 1)) / any_value(ideal) AS ndcg_at_k, sum(growth_abs) AS net_growth, median(class_fills) AS median_base FROM r, t, i WHERE p <= {BUDGET} GROUP BY rule""", "value_capture abs_capture eb_share_capture precision_at_k ndcg_at_k net_growth median_base")
def ev1_rule_metrics(s: Spark, d: str) -> DataFrame:
    return evaluate.rule_metrics(value_panel(s, d), {"volume": "class_fills", "frontier": "opportunity"}, BUDGET)


@query(None)
def ev5_shrinkage_comparison(s: Spark, d: str) -> DataFrame:
    return evaluate.shrinkage_comparison(train_panel(s, d), value_panel(s, d), BUDGET)


@query(f"WITH {PANEL}, {VALUE} SELECT corr(eb_share, eb_growth_share) AS mean_reversion, stddev_samp(growth_share) FILTER (class_fills_observed < 20) AS sd_raw_small, stddev_samp(eb_growth_share) FILTER (class_fills_observed < 20) AS sd_shrunk_small, stddev_samp(growth_share) FILTER (class_fills_observed >= 20) AS sd_raw_large, stddev_samp(eb_growth_share) FILTER (class_fills_observed >= 20) AS sd_shrunk_large FROM val", "mean_reversion sd_raw_small sd_shrunk_small sd_raw_large sd_shrunk_large")
def ev5_mean_reversion(s: Spark, d: str) -> DataFrame:
    return evaluate.mean_reversion(value_panel(s, d))


@query(None)
def rs5_ev12_ceiling(s: Spark, d: str) -> DataFrame:
    p = materialise(value_panel(s, d).select("npi", "specialty_group", "class_fills", "opportunity", "eb_share", "class_obs_next", "brand_fills_next", *evaluate.OUTCOMES))
    rules = evaluate.rule_metrics(p, {"volume": "class_fills", "frontier": "opportunity"}, BUDGET)
    return evaluate.ceiling_table(rules, evaluate.noise_ceiling(p, train_priors(s, d), BUDGET))


def _links(s: Spark, d: str) -> DataFrame:
    return T.lines(s, d).where("year = 1999").select("npi", F.col("l_suppkey").alias("practice"))


@query(None)
def rs4_ev13_practice_icc(s: Spark, d: str) -> DataFrame:
    p = materialise(value_panel(s, d))
    return evaluate.practice_icc(materialise(evaluate.practices(_links(s, d), p)), p, "eb_share")


@query(None)
def ev13_peer_value(s: Spark, d: str) -> DataFrame:
    p = materialise(value_panel(s, d))
    return evaluate.peer_value(train_panel(s, d), p, materialise(evaluate.practices(_links(s, d), p)), BUDGET)


@query(f"""WITH {PANEL}, {VALUE}, {LINKS}, mm AS (SELECT l.npi, l.practice FROM links l SEMI JOIN val v ON v.npi = l.npi QUALIFY count(*) OVER (PARTITION BY practice) BETWEEN 2 AND 500), li AS (SELECT npi FROM val ORDER BY opportunity DESC, npi LIMIT {BUDGET}),
ma AS (SELECT DISTINCT npi FROM mm WHERE practice IN (SELECT practice FROM mm SEMI JOIN li USING (npi)) EXCEPT SELECT npi FROM li) SELECT (SELECT count(*) FROM ma) AS mates, sum(greatest(eb_share_fills, 0)) FILTER (npi IN (FROM ma)) / sum(greatest(eb_share_fills, 0)) AS value_share FROM val""", "value_share")
def ev13_unlisted_mates(s: Spark, d: str) -> DataFrame:
    p = materialise(value_panel(s, d))
    return evaluate.unlisted_mates(p, R.top_k(p, "opportunity", BUDGET), evaluate.practices(_links(s, d), p))


@query(None)
def d34_bootstrap_frontier(s: Spark, d: str) -> DataFrame:
    return blends.bootstrap_frontier(_panel(s, d), BUDGET, WEIGHTS)


@query(None)
def d34_robust_weight(s: Spark, d: str) -> DataFrame:
    return blends.robust_weight(blends.bootstrap_frontier(_panel(s, d), BUDGET, WEIGHTS))


# Segments


def _segment_panel(s: Spark, d: str) -> DataFrame:
    years = materialise(stats.union_all([T.scored(s, d, y).select("npi", "year", "brand_share", "class_fills", "opportunity_pct_of_potential") for y in T.YEARS]))
    return segments.panel(years, T.payments(s, d), T.YEARS)


@query("""WITH f3 AS (SELECT year, specialty_group, quantile_cont(class_fills, 0.8) AS f FROM mart WHERE class_fills > 0 GROUP BY ALL), o3 AS (SELECT m.*, greatest(coalesce(f, 0), class_fills) AS pot, b.achievable_share AS ach FROM mart m LEFT JOIN f3 USING (year, specialty_group) LEFT JOIN bench b ON b.specialty_group = m.specialty_group AND b.region IS NOT DISTINCT FROM m.region AND b.year = m.year),
s3 AS (SELECT npi, year, brand_share, class_fills, CASE WHEN class_fills > 0 THEN coalesce(greatest(pot * a - brand_fills, 0) / nullif(pot * a, 0), 0) ELSE 0 END AS opp FROM (SELECT *, coalesce(ach, median(ach) OVER (PARTITION BY year)) AS a FROM o3)),
w AS (SELECT npi, max(brand_share) FILTER (year = 1998) AS s1, max(brand_share) FILTER (year = 1999) AS s2, max(brand_share) FILTER (year = 2000) AS s3, max(class_fills) FILTER (year = 1999) AS c2, max(class_fills) FILTER (year = 2000) AS c3, max(opp) FILTER (year = 2000) AS o FROM s3 GROUP BY npi)
SELECT npi, coalesce(s3, 0) AS brand_share, coalesce(s3 - s2, 0) AS share_delta_recent, coalesce(s2 - s1, 0) AS share_delta_prior, ln(1 + c3) AS log_class_fills, CASE WHEN c2 IS NULL THEN 0 ELSE (c3 - c2) / greatest(c2, 1) END AS class_growth, ln(1 + coalesce(paid, 0)) AS log_payments, coalesce(o, 0) AS opportunity_pct FROM w LEFT JOIN (SELECT npi, sum(pay_total) AS paid FROM pay GROUP BY 1) USING (npi) WHERE c3 > 0""", "brand_share share_delta_recent share_delta_prior log_class_fills class_growth log_payments opportunity_pct")
def ev14_segment_panel(s: Spark, d: str) -> DataFrame:
    return _segment_panel(s, d)


@query(None)
def ev15_choose_k(s: Spark, d: str) -> DataFrame:
    return segments.choose_k(segments.standardised(_segment_panel(s, d)))


@query(None)
def ev16_profile(s: Spark, d: str) -> DataFrame:
    return segments.profile(segments.clusters(segments.standardised(_segment_panel(s, d)), 5))


@query("""WITH p AS (SELECT specialty_group AS cluster, avg(brand_share) AS a, avg(brand_growth_abs / 100) AS b, avg(share_growth) AS c, avg(ln(1 + class_fills)) AS d, avg(opportunity_pct_of_potential) AS e FROM hold GROUP BY 1),
z AS (SELECT cluster, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b, (c - avg(c) OVER ()) / stddev_pop(c) OVER () AS c, (d - avg(d) OVER ()) / stddev_pop(d) OVER () AS d, (e - avg(e) OVER ()) / stddev_pop(e) OVER () AS e FROM p),
l AS (SELECT cluster, unnest(['Loyal Advocates', 'Rising Switchers', 'Untapped Potential', 'Generic Anchors', 'Eroding Base', 'Low-Value Tail', 'Steady Core']) AS label, unnest([a - e - abs(b), 2 * b + c, e - a + d / 2, -a - abs(b), -2 * b, -2 * d, d - abs(b) - abs(a)]) AS score FROM z)
SELECT cluster, label, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, cluster) AS position FROM l WHERE score > 0""", "score")
def ev16_label_scores(s: Spark, d: str) -> DataFrame:
    """Label scores of profiles by specialty group, which SQL can follow; k-means clusters take the same path."""
    profiles = T.holdout(s, d).groupBy(F.col("specialty_group").alias("cluster")).agg(F.avg("brand_share").alias("brand_share"), F.avg(F.col("brand_growth_abs") / 100).alias("share_delta_recent"), F.avg("share_growth").alias("share_delta_prior"), F.avg(F.log1p("class_fills")).alias("log_class_fills"), F.avg("opportunity_pct_of_potential").alias("opportunity_pct"))
    return segments.label_scores(profiles)


# Sizing


@query("WITH r AS (SELECT opportunity, row_number() OVER (ORDER BY opportunity DESC, npi) AS k FROM scored), x AS (SELECT avg(opportunity) FILTER (k <= 150) AS a, avg(opportunity) FILTER (k > 150 AND k <= 180) AS b FROM r) SELECT CASE WHEN a > 0 THEN 0.2 * greatest(1 - b / a, 0) ELSE 0.2 END AS cost_fraction FROM x", "cost_fraction")
def d43_hold_out_cost(s: Spark, d: str) -> DataFrame:
    return sizing.hold_out_cost(T.scored(s, d), BUDGET)
