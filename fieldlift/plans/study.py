"""Queries of statistics, sizing, territories, contracts, reads, sources and streams over the bound tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.session import materialise
from ..operators import backtest as B
from ..operators import opportunity as O
from ..operators import quality as Q
from ..operators import ranks as R
from ..operators import reads, resample, sizing, stats, territory
from ..sources import files
from ..streaming import ingest
from . import fixture as T
from .core import PANEL, _panel
from .registry import query

Spark = SparkSession


def _folder(s: Spark) -> str:
    """A new folder in the shared checkpoint folder."""
    materialise(s.range(0))
    return f"{s.sparkContext.getCheckpointDir().rstrip('/')}/files-{uuid.uuid4().hex}"


def _cohort(s: Spark, d: str) -> DataFrame:
    """Treated: first focus touch in the fit year; control: never; accounts touched before are left out."""
    onset = T.payments(s, d).groupBy("npi").agg(F.min(F.when(F.col("pay_focus") > 0, F.col("year"))).alias("first"), F.sum("pay_total").alias("paid"))
    m = T.mart(s, d).groupBy("npi").pivot("year", list(T.YEARS)).agg(F.first("brand_share").alias("share"), F.first("class_fills").alias("fills"), F.first("risk_score").alias("risk"))
    rows = m.join(onset, "npi", "left").where("first is null or first >= 1999")
    pre, post = F.col("1999_share") - F.col("1998_share"), F.col("2000_share") - F.col("1999_share")
    return rows.join(T.customers(s, d).select("npi", "state"), "npi").select("npi", "state", (F.coalesce(F.col("first") == 1999, F.lit(False))).alias("treated"), F.log1p("1999_fills").alias("log_fills"), F.col("1999_risk").alias("risk"), pre.alias("pre_delta"), post.alias("post_delta"), F.col("1999_share").alias("share_pre"), F.col("2000_share").alias("share_post"), F.coalesce("paid", F.lit(0.0)).alias("paid"))


COHORT = """onset AS (SELECT npi, min(year) FILTER (pay_focus > 0) AS first, sum(pay_total) AS paid FROM pay GROUP BY npi),
wide AS (SELECT npi, max(brand_share) FILTER (year = 1998) AS s98, max(brand_share) FILTER (year = 1999) AS s99, max(brand_share) FILTER (year = 2000) AS s00, max(class_fills) FILTER (year = 1999) AS f99, max(risk_score) FILTER (year = 1999) AS r99 FROM mart GROUP BY npi),
cohort AS (SELECT w.npi, c.state, coalesce(first = 1999, false) AS treated, ln(1 + f99) AS log_fills, r99 AS risk, s99 - s98 AS pre_delta, s00 - s99 AS post_delta, s99 AS share_pre, s00 AS share_post, coalesce(paid, 0) AS paid FROM wide w JOIN cust c ON c.npi = w.npi LEFT JOIN onset o ON o.npi = w.npi WHERE first IS NULL OR first >= 1999)"""


@query(f"WITH {COHORT} SELECT * FROM cohort", "log_fills risk pre_delta post_delta share_pre share_post paid")
def rs7_treatment_cohort(s: Spark, d: str) -> DataFrame:
    return _cohort(s, d)


@query(f"""WITH {COHORT}, l AS (SELECT treated, 'log_fills' AS covariate, log_fills AS v FROM cohort UNION ALL SELECT treated, 'risk', risk FROM cohort)
SELECT covariate, avg(v) FILTER (treated) AS mean_treated, avg(v) FILTER (NOT treated) AS mean_control, (avg(v) FILTER (treated) - avg(v) FILTER (NOT treated)) / nullif(sqrt((var_samp(v) FILTER (treated) + var_samp(v) FILTER (NOT treated)) / 2), 0) AS smd FROM l GROUP BY covariate""", "mean_treated mean_control smd")
def ag15_balance(s: Spark, d: str) -> DataFrame:
    return stats.balance(_cohort(s, d), "treated", ["log_fills", "risk"])


@query(f"""WITH {COHORT}, m AS (SELECT avg(pre_delta) FILTER (treated) AS m1, avg(pre_delta) FILTER (NOT treated) AS m0, var_samp(pre_delta) FILTER (treated) AS v1, var_samp(pre_delta) FILTER (NOT treated) AS v0, count(pre_delta) FILTER (treated) AS n1, count(pre_delta) FILTER (NOT treated) AS n0 FROM cohort)
SELECT m1 - m0 AS difference, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS dof, n1, n0 FROM m""", "difference t dof")
def ag16_rs9_welch(s: Spark, d: str) -> DataFrame:
    return stats.welch(_cohort(s, d), "treated", "pre_delta")


@query(None)
def ag16_p_value(s: Spark, d: str) -> DataFrame:
    """The test's p-value; SQL has no distribution function for it."""
    return stats.welch(_cohort(s, d), "treated", "pre_delta").withColumn("p_value", stats.p_value(F.col("t"), F.col("dof")))


@query(f"WITH {COHORT} SELECT avg(share_post - share_pre) FILTER (treated) AS treated_change, avg(share_post - share_pre) FILTER (NOT treated) AS control_change, avg(share_post - share_pre) FILTER (treated) - avg(share_post - share_pre) FILTER (NOT treated) AS did FROM cohort", "treated_change control_change did")
def ag17_rs10_did(s: Spark, d: str) -> DataFrame:
    return stats.did(_cohort(s, d), "treated", "share_pre", "share_post")


@query(None)
def rs2_cluster_bootstrap(s: Spark, d: str) -> DataFrame:
    return stats.did_cluster_bootstrap(_cohort(s, d).where("post_delta is not null"), "treated", "post_delta", "state")


@query(f"""WITH {COHORT}, x AS (SELECT ln(1 + paid) AS x, post_delta AS y FROM cohort WHERE post_delta IS NOT NULL)
SELECT CASE WHEN regr_sxx(y, x) > 0 THEN regr_slope(y, x) END AS slope, CASE WHEN regr_sxx(y, x) > 0 THEN regr_intercept(y, x) END AS intercept, CASE WHEN regr_sxx(y, x) > 0 THEN sqrt(greatest((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / ((count(*) - 2) * regr_sxx(y, x)), 0)) END AS se, count(*) AS n FROM x""", "slope intercept se")
def ag18_rs8_elasticity(s: Spark, d: str) -> DataFrame:
    return stats.ols(_cohort(s, d).withColumn("log_paid", F.log1p("paid")), "post_delta", "log_paid")


@query("""WITH g AS (SELECT zip3, count(*) AS n, avg(brand_share) AS m, coalesce(var_samp(brand_share), 0) AS v FROM mart WHERE year = 1999 AND brand_share IS NOT NULL GROUP BY zip3 HAVING count(*) > 1),
t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * n) AS n2, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum((n - 1) * v) AS ssw FROM g), u AS (SELECT *, (nmm - nm * nm / nn) / (k - 1) AS msb, ssw / (nn - k) AS msw, (nn - n2 / nn) / (k - 1) AS n0 FROM t)
SELECT k, nn::BIGINT AS "N", (msb - msw) / (msb + (n0 - 1) * msw) AS icc FROM u""", "icc")
def ag19_icc(s: Spark, d: str) -> DataFrame:
    return stats.icc(T.mart(s, d).where("year = 1999"), "zip3", "brand_share")


@query("""WITH r AS (SELECT zip3, brand_share AS y FROM mart WHERE year = 1999 AND brand_share IS NOT NULL QUALIFY count(*) OVER (PARTITION BY zip3) > 1),
g AS (SELECT zip3, count(*) AS n, avg(y) AS m, sum((y - mean) ** 2) AS inside FROM (SELECT *, avg(y) OVER (PARTITION BY zip3) AS mean FROM r) GROUP BY zip3),
t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * (m - (SELECT avg(y) FROM r)) ** 2) / (count(*) - 1) AS msb, sum(inside) / (sum(n) - count(*)) AS msw, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS n0 FROM g)
SELECT k, nn::BIGINT AS "N", CASE WHEN k >= 3 THEN greatest((msb - msw) / (msb + (n0 - 1) * msw), 0) ELSE 0 END AS icc FROM t""", "icc")
def ag19_icc_floored(s: Spark, d: str) -> DataFrame:
    return stats.icc(T.mart(s, d).where("year = 1999"), "zip3", "brand_share", floored=True)


@query("""WITH e AS (SELECT quantile_cont(class_fills, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM mart WHERE year = 1999),
b AS (SELECT year, len(list_filter(q, lambda x: x <= class_fills)) AS b FROM mart, e WHERE year IN (1999, 2000)), c AS (SELECT b, count(*) FILTER (year = 1999) AS c0, count(*) FILTER (year = 2000) AS c1 FROM b GROUP BY b),
s AS (SELECT greatest(c1 / sum(c1) OVER (), 1e-4) AS a, greatest(c0 / sum(c0) OVER (), 1e-4) AS p FROM c) SELECT sum((a - p) * ln(a / p)) AS psi FROM s""", "psi")
def ag20_psi(s: Spark, d: str) -> DataFrame:
    m = T.mart(s, d)
    return stats.psi_numeric(m.where("year = 1999"), m.where("year = 2000"), "class_fills")


@query("""WITH c AS (SELECT specialty_group AS b, count(*) FILTER (year = 1999) AS c0, count(*) FILTER (year = 2000) AS c1 FROM mart GROUP BY 1), s AS (SELECT greatest(c1 / sum(c1) OVER (), 1e-4) AS a, greatest(c0 / sum(c0) OVER (), 1e-4) AS p FROM c) SELECT sum((a - p) * ln(a / p)) AS psi FROM s""", "psi", 6)
def ag20_psi_categorical(s: Spark, d: str) -> DataFrame:
    m = T.mart(s, d)
    return stats.psi_categorical(m.where("year = 1999"), m.where("year = 2000"), "specialty_group")


@query("""WITH c AS (SELECT class_fills AS v, count(*) FILTER (year = 1999) AS a, count(*) FILTER (year = 2000) AS b FROM mart WHERE year IN (1999, 2000) GROUP BY 1), r AS (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb FROM c WINDOW w AS (ORDER BY v)) SELECT max(abs(fa - fb)) AS ks FROM r""", "ks")
def ag21_ks(s: Spark, d: str) -> DataFrame:
    m = T.mart(s, d)
    return stats.ks(m.where("year = 1999"), m.where("year = 2000"), "class_fills")


def prior_sql(rows: str) -> str:
    """Moments in two passes: deviations from each group's mean, and the noise of each row."""
    return f"""pr AS (SELECT specialty_group AS g, greatest(brand_fills, 0) AS y, greatest(class_fills_observed, 0) AS n FROM {rows}),
pu AS (SELECT g, n, y / n AS p FROM pr WHERE n > 0 QUALIFY n >= 20 OR count(*) FILTER (n >= 20) OVER (PARTITION BY g) < 30),
pm AS (SELECT *, sum(n * p) OVER (PARTITION BY g) / sum(n) OVER (PARTITION BY g) AS m FROM pu),
pk AS (SELECT g, any_value(m) AS m, least(greatest(any_value(m * (1 - m)) / greatest(sum(n * (p - m) ** 2) / sum(n) - sum(n * (m * (1 - m) / n)) / sum(n), 1e-6) - 1, 1), 5000) AS strength FROM pm GROUP BY g),
prior AS (SELECT g AS specialty_group, c AS mean, strength, c * strength AS a, (1 - c) * strength AS b, (SELECT count(*) FROM pr WHERE pr.g = pk.g) AS accounts FROM (SELECT *, least(greatest(m, 0.0001), 0.9999) AS c FROM pk) pk)"""


@query(f"WITH {prior_sql('(FROM mart WHERE year = 1999)')} SELECT * FROM prior", "mean strength a b")
def ag22_beta_prior(s: Spark, d: str) -> DataFrame:
    return stats.beta_prior(T.mart(s, d).where("year = 1999"), "specialty_group", "brand_fills", "class_fills_observed")


VALUE = f"""{prior_sql('(FROM mart WHERE year = 1998 AND class_fills > 0)')}, vx AS (SELECT p.*, coalesce(n.brand_fills, 0) AS by_, coalesce(n.class_fills_observed, 0) AS bn, coalesce(q.a, (SELECT median(a) FROM prior)) AS pa, coalesce(q.b, (SELECT median(b) FROM prior)) AS pb FROM panel p LEFT JOIN prior q USING (specialty_group) LEFT JOIN mart n ON n.npi = p.npi AND n.year = 2000),
val AS (SELECT *, (least(brand_fills, class_fills_observed) + pa) / (class_fills_observed + pa + pb) AS eb_share, (least(by_, bn) + pa) / (bn + pa + pb) AS eb_share_next, (least(by_, bn) + pa) / (bn + pa + pb) - (least(brand_fills, class_fills_observed) + pa) / (class_fills_observed + pa + pb) AS eb_growth_share,
  ((least(by_, bn) + pa) / (bn + pa + pb) - (least(brand_fills, class_fills_observed) + pa) / (class_fills_observed + pa + pb)) * class_fills AS eb_share_fills FROM vx)"""


def train_priors(s: Spark, d: str) -> DataFrame:
    """Priors of the in-market accounts of the period before the fit period; a row per group."""
    return materialise(stats.beta_prior(T.mart(s, d).where("year = 1998 and class_fills > 0"), "specialty_group", "brand_fills", "class_fills_observed"))


def value_panel(s: Spark, d: str) -> DataFrame:
    return stats.shrunk_growth(_panel(s, d), train_priors(s, d))


@query(f"WITH {PANEL}, {VALUE} SELECT npi, eb_share, eb_share_next, eb_growth_share, eb_share_fills FROM val", "eb_share eb_share_next eb_growth_share eb_share_fills")
def ev4_shrink(s: Spark, d: str) -> DataFrame:
    return value_panel(s, d).select("npi", "eb_share", "eb_share_next", "eb_growth_share", "eb_share_fills")


SEG = """seg AS (SELECT 'all' AS segment, 'all' AS level, * FROM hold UNION ALL SELECT 'specialty_group', specialty_group, * FROM hold UNION ALL SELECT 'region', region, * FROM hold)"""


@query(f"WITH {SEG} SELECT segment, level, count(*) AS n, avg(abs(brand_fills - brand_fills_next)) AS mae, avg(brand_fills - brand_fills_next) AS bias, sum(brand_fills - brand_fills_next) / sum(brand_fills_next) AS relative_bias FROM seg GROUP BY ALL HAVING count(*) >= 20", "mae bias relative_bias")
def ag23_ev10_segment_errors(s: Spark, d: str) -> DataFrame:
    return stats.segment_errors(T.holdout(s, d), ["specialty_group", "region"], "brand_fills", "brand_fills_next", 20)


@query(f"WITH {SEG} SELECT segment, level, count(*) FILTER (flagged) / (SELECT count(*) FROM hold WHERE flagged) AS list_share, sum(class_fills) / (SELECT sum(class_fills) FROM hold) AS value_share, count(*) FILTER (flagged) / (SELECT count(*) FROM hold WHERE flagged) / (sum(class_fills) / (SELECT sum(class_fills) FROM hold)) AS ratio FROM seg GROUP BY ALL", "list_share value_share ratio")
def ag24_representation(s: Spark, d: str) -> DataFrame:
    return stats.representation(T.holdout(s, d), ["specialty_group", "region"], "flagged", "class_fills")


@query(f"WITH {SEG} SELECT segment, level, count(*) AS n, avg((brand_fills_next BETWEEN brand_fills * 0.5 AND brand_fills * 1.5 + 10)::INT) AS coverage, median(brand_fills * 1.5 + 10 - brand_fills * 0.5) AS median_width FROM seg GROUP BY ALL HAVING count(*) >= 20", "coverage median_width")
def ag25_coverage(s: Spark, d: str) -> DataFrame:
    h = T.holdout(s, d).withColumn("lo", F.col("brand_fills") * 0.5).withColumn("hi", F.col("brand_fills") * 1.5 + 10)
    return stats.coverage(h, ["specialty_group", "region"], "lo", "hi", "brand_fills_next", 20)


@query("SELECT bin, avg(brand_fills) AS mean_predicted, avg(brand_fills_next) AS mean_actual, count(*) AS n FROM (SELECT *, greatest(ceil((row_number() OVER (ORDER BY brand_fills, npi) - 1) / (count(*) OVER () - 1) * 10), 1)::INT AS bin FROM hold) GROUP BY bin", "mean_predicted mean_actual")
def ag26_calibration(s: Spark, d: str) -> DataFrame:
    return stats.calibration(T.holdout(s, d), "brand_fills", "brand_fills_next")


LINKS = "links AS (SELECT DISTINCT npi, l_suppkey AS practice FROM line_ WHERE year = 1999)"


@query(f"""WITH {LINKS}, m AS (SELECT l.npi, practice, brand_share AS v FROM links l JOIN mart s ON s.npi = l.npi AND s.year = 1999 WHERE brand_share IS NOT NULL), g AS (SELECT practice, sum(v) AS s, count(*) AS n FROM m GROUP BY 1 HAVING count(*) > 1)
SELECT npi, avg((s - v) / (n - 1)) AS peer_mean, count(*) AS practices FROM m JOIN g USING (practice) GROUP BY npi""", "peer_mean")
def ag27_leave_one_out(s: Spark, d: str) -> DataFrame:
    links = T.lines(s, d).where("year = 1999").select("npi", F.col("l_suppkey").alias("practice")).distinct()
    return stats.leave_one_out(links, T.mart(s, d).where("year = 1999"), "brand_share")


@query(f"""WITH {LINKS}, f AS (SELECT npi FROM hold WHERE flagged), p AS (SELECT DISTINCT practice FROM links SEMI JOIN f USING (npi)) SELECT DISTINCT npi FROM links SEMI JOIN p USING (practice) EXCEPT SELECT npi FROM f""")
def j14_practice_mates(s: Spark, d: str) -> DataFrame:
    links = T.lines(s, d).where("year = 1999").select("npi", F.col("l_suppkey").alias("practice")).distinct()
    listed = T.holdout(s, d).where("flagged").select("npi")
    return links.join(links.join(listed, "npi", "left_semi").select("practice"), "practice", "left_semi").select("npi").distinct().join(listed, "npi", "left_anti")


@query("SELECT least(floor(opportunity_pct_of_potential * 20), 19)::INT AS bin, count(*) FILTER (flagged) AS treated, count(*) FILTER (NOT flagged) AS control FROM hold GROUP BY 1")
def ag31_histogram(s: Spark, d: str) -> DataFrame:
    return stats.histogram(T.holdout(s, d), "opportunity_pct_of_potential", "flagged")


DOSE = """dose AS (SELECT m.npi, greatest(ceil((row_number() OVER (ORDER BY m.class_fills, m.npi) - 1) / (count(*) OVER () - 1) * 10), 1)::INT AS vol_decile, least(coalesce(p.focus_events, 0), 36)::INT AS calls,
  least(1, greatest(-1, (coalesce(n.brand_share, 0) - coalesce(m.brand_share, 0)) / greatest(0.01, 1 - coalesce(m.brand_share, 0)))) AS captured FROM mart m JOIN mart n ON n.npi = m.npi AND n.year = 2000 LEFT JOIN pay p ON p.npi = m.npi AND p.year = 1999 WHERE m.year = 1999 AND m.class_fills > 0)"""


def dose_panel(s: Spark, d: str) -> DataFrame:
    m = T.mart(s, d)
    both = m.where("year = 1999 and class_fills > 0").select("npi", "class_fills", "brand_share").join(m.where("year = 2000").select("npi", F.col("brand_share").alias("brand_share_next")), "npi")
    p = T.payments(s, d).where("year = 1999").select("npi", F.least("focus_events", F.lit(36)).cast("int").alias("calls"))
    now = R.quantile_cut(materialise(both), "class_fills", "vol_decile").join(p, "npi", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    return stats.captured_headroom(now).select("npi", "vol_decile", "calls", "captured")


@query(f"""WITH {DOSE}, z AS (SELECT vol_decile, avg(captured) AS base FROM dose WHERE calls = 0 GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT calls, count(*) AS n, avg(captured) - any_value(base) AS excess FROM dose JOIN z USING (vol_decile) GROUP BY vol_decile, calls HAVING count(*) >= 2)
SELECT calls, sum(excess * n) / sum(n) AS captured_excess, sum(n)::BIGINT AS n FROM c GROUP BY calls""", "captured_excess")
def rs12_dose_response(s: Spark, d: str) -> DataFrame:
    return stats.dose_response(dose_panel(s, d), 2)


@query(f"""WITH {PANEL}, v AS (SELECT *, greatest(growth_abs, 0) AS rel FROM panel), l AS (SELECT *, row_number() OVER (ORDER BY opportunity DESC, npi) AS r, row_number() OVER (ORDER BY rel DESC, npi) AS br FROM v)
SELECT sum(greatest(growth_abs, 0)) FILTER (r <= 150) / sum(greatest(growth_abs, 0)) AS growth_abs_capture, sum(greatest(growth_share, 0)) FILTER (r <= 150) / sum(greatest(growth_share, 0)) AS growth_share_capture, avg((br <= greatest(1, (SELECT count(*) FROM panel) // 10))::INT) FILTER (r <= 150) AS precision,
 sum(rel / log2(r + 1)) FILTER (r <= 150) / (SELECT sum(rel / log2(br + 1)) FROM l WHERE br <= 150) AS ndcg, median(class_fills) FILTER (r <= 150) AS median_base FROM l""", "growth_abs_capture growth_share_capture precision ndcg median_base")
def ev1_metrics_at_k(s: Spark, d: str) -> DataFrame:
    return stats.ranked_metrics(_panel(s, d), "opportunity", 150, ["growth_abs", "growth_share"], "growth_abs")


@query(None)
def rs1_bootstrap_capture(s: Spark, d: str) -> DataFrame:
    p = R.percent_rank(R.percent_rank(_panel(s, d), "opportunity", "opportunity_rank"), "class_fills", "volume_rank")
    p = materialise(p.withColumn("hybrid", (F.col("opportunity_rank") + F.col("volume_rank")) / 2))
    return resample.bootstrap_capture(p, {"opportunity": "opportunity", "volume": "class_fills", "hybrid": "hybrid"}, "growth_abs", 150, share="growth_share")


@query(None)
def rs3_permutation_test(s: Spark, d: str) -> DataFrame:
    return resample.permutation_test(T.holdout(s, d), "specialty_group", "opportunity", "share_growth")


NUMERIC, CATEGORIES, PAIRS = ("class_fills", "panel_benes", "non_class_clms", "risk_score"), ("specialty_group", "region"), ((1998, 1999), (1999, 2000))


def _drift_sql() -> str:
    """PSI over deciles of the earlier period (or categories), and the largest gap of the distribution functions."""
    parts = []
    for a, b in PAIRS:
        head = f"SELECT {a} AS from_year, {b} AS to_year"
        for c in NUMERIC:
            cells = f"SELECT year, len(list_filter((SELECT quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM mart WHERE year = {a}), lambda x: x <= {c})) AS cell FROM mart WHERE year IN ({a}, {b}) AND {c} IS NOT NULL"
            ks = f"SELECT max(abs(f1 - f0)) FROM (SELECT sum(sum((year = {b})::INT)) OVER (ORDER BY {c}) / (SELECT count({c}) FROM mart WHERE year = {b}) AS f1, sum(sum((year = {a})::INT)) OVER (ORDER BY {c}) / (SELECT count({c}) FROM mart WHERE year = {a}) AS f0 FROM mart WHERE year IN ({a}, {b}) AND {c} IS NOT NULL GROUP BY {c})"
            parts.append(f"{head}, '{c}' AS feature, 'numeric' AS kind, ({_psi_sql(cells, a, b)}) AS psi, ({ks}) AS ks")
        for c in CATEGORIES:
            parts.append(f"{head}, '{c}', 'categorical', ({_psi_sql(f'SELECT year, {c} AS cell FROM mart WHERE year IN ({a}, {b})', a, b)}), NULL::DOUBLE")
    return f"SELECT *, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END AS status FROM ({' UNION ALL '.join(parts)})"


def _psi_sql(cells: str, a: int, b: int) -> str:
    return f"SELECT sum((p1 - p0) * ln(p1 / p0)) FROM (SELECT greatest(count(*) FILTER (year = {b}) / sum(count(*) FILTER (year = {b})) OVER (), 0.0001) AS p1, greatest(count(*) FILTER (year = {a}) / sum(count(*) FILTER (year = {a})) OVER (), 0.0001) AS p0 FROM ({cells}) GROUP BY cell)"


def _drift(s: Spark, d: str) -> DataFrame:
    m = materialise(T.mart(s, d).select("year", *NUMERIC, *CATEGORIES))
    return resample.drift_report({y: m.where(F.col("year") == y) for y in T.YEARS}, NUMERIC, CATEGORIES)


@query(_drift_sql(), "psi ks")
def ev11_drift_report(s: Spark, d: str) -> DataFrame:
    return _drift(s, d)


CONCEPT = """f3 AS (SELECT year, specialty_group, quantile_cont(class_fills, 0.8) AS f FROM mart WHERE class_fills > 0 GROUP BY ALL), a3 AS (SELECT m.*, greatest(coalesce(f, 0), class_fills) AS pot, b.achievable_share AS ach FROM mart m LEFT JOIN f3 USING (year, specialty_group) LEFT JOIN bench b ON b.specialty_group = m.specialty_group AND b.region IS NOT DISTINCT FROM m.region AND b.year = m.year WHERE m.year < 2000),
c3 AS (SELECT x.year, greatest(pot * coalesce(ach, mid) - x.brand_fills, 0) AS o, coalesce(n.brand_fills, 0) - x.brand_fills AS g FROM (SELECT *, median(ach) OVER (PARTITION BY year) AS mid FROM a3) x LEFT JOIN mart n ON n.npi = x.npi AND n.year = x.year + 1 WHERE x.class_fills > 0),
r3 AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY o) + (count(*) OVER (PARTITION BY year, o) - 1) / 2 AS ro, rank() OVER (PARTITION BY year ORDER BY g) + (count(*) OVER (PARTITION BY year, g) - 1) / 2 AS rg, quantile_cont(o, 0.9) OVER (PARTITION BY year) AS cut FROM c3),
concept AS (SELECT year || '->' || (year + 1) AS panel, avg(g) FILTER (o >= cut) / greatest(avg(g), 1e-9) AS top_decile_lift, corr(ro, rg) AS spearman FROM r3 GROUP BY year)"""


def _concept(s: Spark, d: str) -> DataFrame:
    m = T.mart(s, d)
    return resample.concept_drift({f"{y}->{y + 1}": B.growth_panel(T.scored(s, d, y), m.where(F.col("year") == y + 1)) for y in (1998, 1999)})


@query(f"WITH {CONCEPT} SELECT panel, top_decile_lift, spearman FROM concept", "top_decile_lift spearman")
def ev11_concept_drift(s: Spark, d: str) -> DataFrame:
    return _concept(s, d)


@query(f"WITH {CONCEPT}, dr AS ({_drift_sql()}), x AS (SELECT (SELECT max(psi) FROM dr WHERE to_year = 2000) AS worst_input_psi, 0.0::DOUBLE AS score_psi, (SELECT spearman FROM concept WHERE panel = '1999->2000') - (SELECT spearman FROM concept WHERE panel = '1998->1999') AS spearman_change) SELECT *, worst_input_psi >= 0.25 OR abs(spearman_change) > 0.05 AS retrain FROM x", "worst_input_psi spearman_change")
def ev11_retrain(s: Spark, d: str) -> DataFrame:
    return resample.retrain(_drift(s, d), _concept(s, d), 2000)


# Call plan and sizing

CAPACITY = 300.0
PLAN = """want AS (SELECT *, CASE WHEN NOT in_market THEN 0.0 WHEN opportunity_decile >= 9 THEN CASE WHEN coalesce(brand_share, 0) < 0.2 THEN 2.0 WHEN brand_share < 0.5 THEN 1.5 ELSE 0.75 END WHEN opportunity_decile >= 7 THEN CASE WHEN coalesce(brand_share, 0) < 0.2 THEN 1.0 WHEN brand_share < 0.5 THEN 0.75 ELSE 0.25 END ELSE 0.0 END::DOUBLE AS desired_calls,
 CASE WHEN opportunity_decile >= 9 THEN 'Decile 9-10' WHEN opportunity_decile >= 7 THEN 'Decile 7-8' ELSE 'Decile 1-6' END AS decile_band, CASE WHEN coalesce(brand_share, 0) < 0.2 THEN 'Low (<20%)' WHEN brand_share < 0.5 THEN 'Mid (20-50%)' ELSE 'High (>50%)' END AS share_band FROM scored),
plan AS (SELECT *, calls_per_month * 12 AS calls_per_year, calls_per_month > 0 AS is_target FROM (SELECT *, CASE WHEN sum(desired_calls) OVER (ORDER BY opportunity DESC, npi ROWS UNBOUNDED PRECEDING) <= 300 THEN desired_calls ELSE 0 END AS calls_per_month FROM want))"""


#: The study's four rules; the random one is an arithmetic sequence of the key, which SQL can follow.
FOUR = {"opportunity": "opportunity", "volume": "class_fills", "hybrid": "hybrid", "random": "random"}
FOUR_SQL = """SELECT rule, npi, opportunity, CASE rule WHEN 'opportunity' THEN opportunity WHEN 'volume' THEN class_fills WHEN 'hybrid' THEN hy ELSE (npi * 7919 + 104729) % 1000003 END AS sc FROM (SELECT *, round(((rank() OVER (ORDER BY opportunity) + (count(*) OVER (PARTITION BY opportunity) - 1) / 2) / count(*) OVER () + (rank() OVER (ORDER BY class_fills) + (count(*) OVER (PARTITION BY class_fills) - 1) / 2) / count(*) OVER ()) / 2, 12) AS hy FROM i), (VALUES ('opportunity'), ('volume'), ('hybrid'), ('random')) t(rule)"""


def _with_rules(df: DataFrame) -> DataFrame:
    """In-market rows with the hybrid and the random score."""
    inside = materialise(df.where("in_market"))
    mixed = O.hybrid(inside).select("npi", F.round("hybrid", 12).alias("hybrid"))
    return inside.join(mixed, "npi").withColumn("random", ((F.col("npi") * 7919 + 104729) % 1000003).cast("double"))


def _plan(s: Spark, d: str) -> DataFrame:
    return sizing.call_plan(T.scored(s, d), CAPACITY)


@query(f"WITH {PLAN} SELECT npi, opportunity, opportunity_decile, decile_band, share_band, desired_calls, calls_per_month, calls_per_year, is_target FROM plan", "opportunity")
def d19_call_plan(s: Spark, d: str) -> DataFrame:
    return _plan(s, d).select("npi", "opportunity", "opportunity_decile", "decile_band", "share_band", "desired_calls", "calls_per_month", "calls_per_year", "is_target")


@query(f"WITH {PLAN} SELECT d AS decile_band, b AS share_band, count(npi) AS accounts, count(*) FILTER (is_target) AS targets, coalesce(sum(calls_per_month), 0) AS calls, coalesce(sum(opportunity), 0) AS opportunity FROM (SELECT unnest(['Decile 9-10', 'Decile 7-8', 'Decile 1-6']) AS d), (SELECT unnest(['Low (<20%)', 'Mid (20-50%)', 'High (>50%)']) AS b) LEFT JOIN plan ON decile_band = d AND share_band = b GROUP BY ALL", "calls opportunity")
def ag10_matrix_summary(s: Spark, d: str) -> DataFrame:
    return sizing.matrix_summary(_plan(s, d))


@query(f"WITH {PLAN} SELECT count(*) FILTER (desired_calls > 0) AS wanted, count(*) FILTER (is_target) AS targets, count(*) FILTER (is_target) / count(*) FILTER (desired_calls > 0) AS served, sum(calls_per_month) / 9600.0 AS utilisation, sum(desired_calls) AS demand, sum(desired_calls) / 160.0 AS implied_reps FROM plan", "served utilisation demand implied_reps")
def d22_plan_summary(s: Spark, d: str) -> DataFrame:
    return sizing.plan_summary(_plan(s, d), 60)


@query(f"""WITH {PLAN}, k AS (SELECT floor(300 / avg(desired_calls))::INT AS k FROM plan WHERE desired_calls > 0), i AS (SELECT * FROM plan WHERE in_market), i4 AS ({FOUR_SQL}), t AS (SELECT rule, opportunity, row_number() OVER (PARTITION BY rule ORDER BY sc DESC, npi) AS r FROM i4)
SELECT rule, any_value(k) AS k, sum(opportunity) / (SELECT sum(opportunity) FROM i) AS reach, any_value(k) >= (SELECT count(*) FROM i) AS vacuous FROM t, k WHERE r <= k GROUP BY rule""", "reach")
def d21_reach_at_budget(s: Spark, d: str) -> DataFrame:
    return sizing.reach_at_budget(_with_rules(_plan(s, d)), FOUR, CAPACITY)


@query(f"""WITH {PLAN}, i AS (SELECT * FROM plan WHERE in_market), n AS (SELECT count(*) AS n FROM i), v AS (SELECT rule, npi, sc, opportunity AS g FROM ({FOUR_SQL})),
c AS (SELECT rule, row_number() OVER w AS rn, sum(g) OVER w AS cum, sum(g) OVER (PARTITION BY rule) AS tot FROM v WINDOW w AS (PARTITION BY rule ORDER BY sc DESC, npi ROWS UNBOUNDED PRECEDING)) SELECT rule, p AS point, rn / n AS list_share, cum / tot AS captured FROM c, n, range(1, 61) t(p) WHERE rn = ceil(p * n / 60)""", "list_share captured")
def d20_reach_curve(s: Spark, d: str) -> DataFrame:
    inside = materialise(_with_rules(_plan(s, d)).where("in_market"))
    return B.gain_curve(inside, FOUR, "opportunity", 60)


#: Small forces, as the bound tables are small, and the whole grid of the study.
SMALL = [1, 2, 3, 4, 5, 6, 8, 10, *range(30, 701, 10)]
EVAL = f"""{PLAN}, rk AS (SELECT npi, opportunity, 12 * desired_calls AS wanted, sum(12 * desired_calls) OVER (ORDER BY opportunity DESC, npi ROWS UNBOUNDED PRECEDING) AS cum FROM plan WHERE desired_calls > 0),
ev AS (SELECT n::DOUBLE AS n_reps, n * 8.0 * 20 * 12 AS cap, CASE WHEN cum <= n * 1920.0 THEN wanted ELSE greatest(n * 1920.0 - (cum - wanted), 0) END AS calls, opportunity FROM rk, (SELECT unnest({SMALL}) AS n)),
ec AS (SELECT n_reps, any_value(cap)::DOUBLE AS annual_call_capacity, sum(calls) AS calls_allocated, count(*) FILTER (calls > 0) AS accounts_reached, sum(opportunity * 0.28 * calls / (12 + calls)) AS incremental_fills FROM ev GROUP BY 1),
cv AS (SELECT *, incremental_fills * 380 * 0.87 AS contribution, n_reps * 250000.0 AS field_cost FROM ec),
roi AS (SELECT *, contribution - field_cost AS profit, contribution / field_cost AS roi, (contribution - lag(contribution) OVER (ORDER BY n_reps)) / (n_reps - lag(n_reps) OVER (ORDER BY n_reps)) AS marginal_contribution, (contribution - lag(contribution) OVER (ORDER BY n_reps)) / (n_reps - lag(n_reps) OVER (ORDER BY n_reps)) / 250000 AS marginal_roi FROM cv)"""


def _curve(s: Spark, d: str) -> DataFrame:
    return sizing.roi_curve(sizing.evaluate(sizing.allocation(_plan(s, d)), sizing.grid(s, {"base": sizing.base_case()}, SMALL)))


ROI = ["n_reps", "annual_call_capacity", "calls_allocated", "accounts_reached", "incremental_fills", "contribution", "field_cost", "profit", "roi", "marginal_contribution", "marginal_roi"]


@query(f"WITH {EVAL} SELECT {', '.join(ROI)} FROM roi", "calls_allocated incremental_fills contribution profit roi marginal_contribution marginal_roi", 3)
def d35_d36_d42_roi_curve(s: Spark, d: str) -> DataFrame:
    return _curve(s, d).select(*ROI)


@query(f"""WITH {EVAL}, x AS (SELECT *, lag(n_reps) OVER w AS pn, lag(marginal_roi) OVER w AS pm FROM roi WHERE marginal_roi IS NOT NULL WINDOW w AS (ORDER BY n_reps))
SELECT 'base' AS scenario, coalesce((SELECT CASE WHEN pn IS NULL OR pm = marginal_roi THEN n_reps ELSE pn + (pm - 1) / (pm - marginal_roi) * (n_reps - pn) END FROM x WHERE marginal_roi < 1 ORDER BY n_reps LIMIT 1), (SELECT max(n_reps) FROM x)) AS break_even_reps""", "break_even_reps")
def d37_break_even(s: Spark, d: str) -> DataFrame:
    return sizing.break_even(_curve(s, d))


def _tornado_sql() -> str:
    """Break-even of each scenario from its own curve: economics as rows of a table, one pass over the ranked accounts."""
    names = list(sizing.ECONOMICS)
    base = {k: v[0] for k, v in sizing.ECONOMICS.items()}
    cases = [(k, side, base | {k: sizing.ECONOMICS[k][i]}) for k in names for i, side in ((1, "low"), (2, "high"))]
    rows = ", ".join(f"('{k}', '{side}', {', '.join(f'{e[n]}::DOUBLE' for n in names)})" for k, side, e in cases)
    return f"""tc AS (SELECT * FROM (VALUES {rows}) v(assumption, side, {', '.join(names)})), tg AS (SELECT tc.*, n::DOUBLE AS n, n * calls_per_rep_per_day * selling_days_per_month * 12 AS cap FROM tc, (SELECT unnest({SMALL}) AS n)),
ts AS (SELECT assumption, side, n, any_value(rep_cost_annual) AS rep, sum(opportunity * call_response_ceiling * q / (call_response_half_saturation + q)) * any_value(net_revenue_per_30day_fill * contribution_margin) AS k FROM (SELECT tg.*, opportunity, greatest(least(wanted, cap - (cum - wanted)), 0) AS q FROM rk, tg) GROUP BY ALL),
tm AS (SELECT *, (k - lag(k) OVER w) / (n - lag(n) OVER w) / rep AS mr FROM ts WINDOW w AS (PARTITION BY assumption, side ORDER BY n)), tp AS (SELECT *, lag(n) OVER w AS pn, lag(mr) OVER w AS pm FROM tm WHERE mr IS NOT NULL WINDOW w AS (PARTITION BY assumption, side ORDER BY n)),
tb AS (SELECT assumption, side, coalesce(arg_min(CASE WHEN pn IS NULL OR pm = mr THEN n ELSE pn + (pm - 1) / (pm - mr) * (n - pn) END, n) FILTER (mr < 1), max(n)) AS be FROM tp GROUP BY ALL),
tornado AS (SELECT assumption, max(be) FILTER (side = 'low') AS at_low, max(be) FILTER (side = 'high') AS at_high, abs(max(be) FILTER (side = 'high') - max(be) FILTER (side = 'low')) AS swing FROM tb GROUP BY 1)"""


@query(f"WITH {EVAL}, {_tornado_sql()} SELECT * FROM tornado", "at_low at_high swing")
def d38_tornado(s: Spark, d: str) -> DataFrame:
    return sizing.tornado(sizing.allocation(_plan(s, d)), SMALL)


@query(f"WITH {EVAL} SELECT 'base' AS scenario, n_reps, CASE WHEN 250000 * 0.28 / marginal_contribution <= 1 THEN 250000 * 0.28 / nullif(marginal_contribution, 0) END AS required_ceiling FROM roi WHERE marginal_contribution IS NOT NULL", "required_ceiling")
def d39_required_ceiling(s: Spark, d: str) -> DataFrame:
    return sizing.required_ceiling(_curve(s, d))


@query(f"""WITH {EVAL}, {_tornado_sql()}, x AS (SELECT *, lag(n_reps) OVER w AS pn, lag(marginal_roi) OVER w AS pm FROM roi WHERE marginal_roi IS NOT NULL WINDOW w AS (ORDER BY n_reps)),
b AS (SELECT coalesce((SELECT CASE WHEN pn IS NULL OR pm = marginal_roi THEN n_reps ELSE pn + (pm - 1) / (pm - marginal_roi) * (n_reps - pn) END FROM x WHERE marginal_roi < 1 ORDER BY n_reps LIMIT 1), (SELECT max(n_reps) FROM x)) AS be)
SELECT be AS break_even_reps, least(be, 9.0) AS recommended_reps, (SELECT min(least(at_low, at_high)) FROM tornado) AS lowest, (SELECT max(greatest(at_low, at_high)) FROM tornado) AS highest, (SELECT greatest(1 - 960.0 / sum(desired_calls), 0) FROM plan) AS unmet_share FROM b""", "break_even_reps recommended_reps lowest highest unmet_share")
def d40_sizing_summary(s: Spark, d: str) -> DataFrame:
    p = materialise(_plan(s, d))
    ranked = materialise(sizing.allocation(p))
    curve = sizing.roi_curve(sizing.evaluate(ranked, sizing.grid(s, {"base": sizing.base_case()}, SMALL)))
    return sizing.sizing_summary(curve, sizing.tornado(ranked, SMALL), 6, demand=p)


@query(f"""WITH {EVAL}, g AS (SELECT max(contribution) FILTER (n_reps = 10) - max(contribution) FILTER (n_reps = 4) AS dk, max(field_cost) FILTER (n_reps = 10) - max(field_cost) FILTER (n_reps = 4) AS dc FROM roi) SELECT CASE WHEN dk > 0 THEN greatest(1, (3 * dc + 60000.0 * 6) / (dk / 0.28 * 2.75) / 0.2) END AS times_required FROM g""", "times_required")
def d44_grow_threshold(s: Spark, d: str) -> DataFrame:
    return sizing.grow_threshold(_curve(s, d), 10, 0.2, 4)


@query(f"""WITH i AS (SELECT * FROM scored WHERE in_market), t AS (SELECT rule, opportunity, row_number() OVER (PARTITION BY rule ORDER BY sc DESC, npi) AS r FROM ({FOUR_SQL}))
SELECT rule, sum(opportunity) * (0.28 * 12 / 24) AS fills, sum(opportunity) * (0.28 * 12 / 24) * 380 * 0.87 AS contribution FROM t WHERE r <= 100 GROUP BY rule""", "fills contribution", 3)
def d41_retargeting_value(s: Spark, d: str) -> DataFrame:
    return sizing.retargeting_value(_with_rules(T.scored(s, d)), FOUR, 100, 12.0)


PAYOFF = f"""{EVAL}, pf AS (SELECT n_reps, r AS response, contribution * c / 0.28 - field_cost - 60000.0 * greatest(n_reps - 4, 0) - 50000.0 * greatest(4 - n_reps, 0) - greatest(contribution - (SELECT contribution FROM roi WHERE n_reps = 4), 0) * c / 0.28 * 0.25 AS payoff FROM roi, (VALUES ('low', 0.15), ('base', 0.28), ('high', 0.4)) v(r, c) WHERE n_reps IN (2, 4, 6, 8)),
py AS (SELECT *, max(payoff) OVER (PARTITION BY response) - payoff AS regret FROM pf)"""


def _payoff(s: Spark, d: str) -> DataFrame:
    return sizing.payoff(_curve(s, d), [2, 4, 6, 8], {"low": 0.15, "base": 0.28, "high": 0.40}, 4)


@query(f"WITH {PAYOFF} SELECT * FROM py", "payoff regret", 2)
def d43_d44_payoff(s: Spark, d: str) -> DataFrame:
    return _payoff(s, d)


@query(f"WITH {PAYOFF} SELECT n_reps, max(regret) AS worst_regret, min(payoff) AS worst_payoff, row_number() OVER (ORDER BY max(regret), n_reps) = 1 AS chosen FROM py GROUP BY n_reps", "worst_regret worst_payoff", 2)
def d44_minimax(s: Spark, d: str) -> DataFrame:
    return sizing.minimax(_payoff(s, d))


# Territories

UNITS = f"""{PLAN}, un AS (SELECT zip3, avg(lat) AS lat, avg(lon) AS lon, any_value(state) AS state, sum(desired_calls) AS workload, count(*) AS accounts, count(*) FILTER (is_target) AS targets, sum(opportunity) AS opportunity, sum(class_fills) AS class_fills, count(*) FILTER (opportunity_decile >= 8) AS high_decile_accounts FROM plan WHERE lat IS NOT NULL GROUP BY zip3)"""
DIST = "round(2 * 3958.7613 * asin(sqrt(least(1, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))), 6)"
EDGES = f"""{UNITS}, nn AS (SELECT x.zip3 AS a, y.zip3 AS b, row_number() OVER (PARTITION BY x.zip3 ORDER BY {DIST}, y.zip3) AS r FROM un x JOIN un y ON x.zip3 <> y.zip3), ed AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM nn WHERE r <= 4)"""
BASELINE = f"""{EDGES}, ba AS (SELECT un.*, floor((row_number() OVER (ORDER BY state, zip3) - 1) / ceil(count(*) OVER () / 5))::INT AS territory FROM un)"""


def _units(s: Spark, d: str) -> DataFrame:
    return territory.units(_plan(s, d))


@query(f"WITH {UNITS} SELECT * FROM un", "lat lon opportunity class_fills")
def ag28_d45_units(s: Spark, d: str) -> DataFrame:
    return _units(s, d)


@query(f"WITH {EDGES} SELECT * FROM ed")
def d46_j11_tk6_adjacency(s: Spark, d: str) -> DataFrame:
    return territory.adjacency(_units(s, d), 4)


@query(f"WITH {BASELINE} SELECT zip3, territory FROM ba")
def d47_baseline(s: Spark, d: str) -> DataFrame:
    return territory.baseline(_units(s, d), 5).select("zip3", "territory")


@query(f"""WITH RECURSIVE {BASELINE.split(', ba AS')[0]}, ba AS{BASELINE.split(', ba AS')[1]}, bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), re AS (SELECT zip3, territory, zip3 AS c FROM ba UNION SELECT y.zip3, y.territory, re.c FROM re JOIN bo ON bo.a = re.zip3 JOIN ba y ON y.zip3 = bo.b AND y.territory = re.territory)
SELECT zip3, territory, min(c) AS component FROM re GROUP BY ALL""")
def d50_components(s: Spark, d: str) -> DataFrame:
    u = materialise(_units(s, d))
    return territory.components(territory.baseline(u, 5), territory.adjacency(u, 4))


@query(f"""WITH {BASELINE}, te AS (SELECT territory, sum(workload) AS w, sum(lat * workload) / sum(workload) AS lat, sum(lon * workload) / sum(workload) AS lon FROM ba GROUP BY 1)
SELECT count(*) AS territories, max(w) / nullif(min(w), 0) AS imbalance, stddev_pop(w) / avg(w) AS workload_cv, (SELECT sum({DIST} * x.workload) / sum(x.workload) FROM ba x JOIN te y USING (territory)) AS travel_miles FROM te""", "imbalance workload_cv travel_miles", 3)
def d53_metrics(s: Spark, d: str) -> DataFrame:
    return territory.metrics(territory.baseline(materialise(_units(s, d)), 5))


@query(f"WITH {BASELINE} SELECT territory, count(*) AS units, sum(workload) AS workload, sum(opportunity) AS opportunity, sum(targets)::BIGINT AS targets FROM ba GROUP BY 1", "opportunity")
def ag29_territory_rollup(s: Spark, d: str) -> DataFrame:
    return territory.territory_rollup(territory.baseline(_units(s, d), 5))


SIZES = [3, 4, 5]


def _solved(s: Spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    u = materialise(_units(s, d))
    edges = materialise(territory.adjacency(u, 6))
    return u, edges, territory.solve(u, edges, SIZES)


@query(None)
def d48_d49_d51_d52_d54_solve(s: Spark, d: str) -> DataFrame:
    return _solved(s, d)[2].select("n_reps", "zip3", "territory", "workload")


@query(None)
def d54_alignment_headline(s: Spark, d: str) -> DataFrame:
    """Balance, travel and pieces of the blocks, plain k-means and the solved alignments."""
    u, edges, solved = _solved(s, d)
    return territory.headline(u, edges, solved, SIZES[-1])


@query(None)
def d28_gates_measured(s: Spark, d: str) -> DataFrame:
    """All gates, with contiguity and balance of the solved alignments."""
    u, edges, solved = _solved(s, d)
    h = T.holdout(s, d)
    measured = territory.headline(u, edges, solved, SIZES[-1]).where("alignment = 'optimised'")
    return B.gates(O.agreement(T.scored(s, d)), B.decile_lift(h), B.head_to_head(h), measured)


@query(f"WITH {BASELINE} SELECT territory, string_agg(DISTINCT plan.state, ', ' ORDER BY plan.state) AS states, count(*) AS accounts, count(*) FILTER (is_target) AS targets, sum(plan.opportunity) AS opportunity FROM plan JOIN ba USING (zip3) GROUP BY territory", "opportunity")
def rq4_ag30_territory_options(s: Spark, d: str) -> DataFrame:
    p = materialise(_plan(s, d))
    return reads.territory_options(p, territory.baseline(territory.units(p), 5))


@query(f"WITH {BASELINE} SELECT npi, territory, is_target, plan.opportunity, row_number() OVER (ORDER BY is_target DESC, plan.opportunity DESC, npi) AS visit_order FROM plan JOIN ba USING (zip3) WHERE territory = 2", "opportunity")
def rq4_w6_j13_call_list(s: Spark, d: str) -> DataFrame:
    p = materialise(_plan(s, d))
    return reads.call_list(p, territory.baseline(territory.units(p), 5), 2).select("npi", "territory", "is_target", "opportunity", "visit_order")


@query("SELECT npi, opportunity, (SELECT count(*) FROM scored WHERE opportunity_decile BETWEEN 1 AND 10 AND specialty_group = 'BUILDING') AS total FROM scored WHERE opportunity_decile BETWEEN 1 AND 10 AND specialty_group = 'BUILDING' ORDER BY opportunity DESC, npi LIMIT 25", "opportunity")
def rq1_rq3_account_list(s: Spark, d: str) -> DataFrame:
    return reads.page(T.scored(s, d), "opportunity", size=25, where=X.account_filter(groups=["BUILDING"])).select("npi", "opportunity", "total")


@query("SELECT npi, opportunity, (SELECT string_agg(year || ':' || round(class_fills, 2), ',' ORDER BY year) FROM mart m WHERE m.npi = s.npi) AS trend, (SELECT string_agg(year || ':' || round(pay_total, 2), ',' ORDER BY year) FROM pay WHERE pay.npi = s.npi) AS payments FROM scored s WHERE in_market AND npi IN (SELECT npi FROM pay) ORDER BY opportunity DESC, npi LIMIT 1", "opportunity")
def rq2_account_detail(s: Spark, d: str) -> DataFrame:
    sc, pay = materialise(T.scored(s, d)), materialise(T.payments(s, d))
    npi = R.top_k(sc.where("in_market").join(pay, "npi", "left_semi"), "opportunity", 1).first()["npi"]
    t = reads.detail(sc, T.mart(s, d), npi, pay)
    line = lambda rows, value: F.array_join(F.transform(rows, lambda x: F.concat(x["year"].cast("string"), F.lit(":"), F.round(x[value], 2).cast("string"))), ",").alias(rows)
    return t.select("npi", "opportunity", line("trend", "class_fills"), line("payments", "pay_total"))


@query("SELECT npi, opportunity, opportunity_decile, state FROM scored WHERE in_market AND opportunity_decile >= 6 AND specialty_group IN ('BUILDING', 'MACHINERY') AND state LIKE '%A%' AND class_fills >= 0.1 * (SELECT max(class_fills) FROM scored WHERE in_market)", "opportunity")
def u2_parameters(s: Spark, d: str) -> DataFrame:
    """Accounts by a set of conditions whose values are parameters of the statement."""
    asked = [reads.Condition("opportunity_decile", ">=", 6), reads.Condition("specialty_group", "in", ["BUILDING", "MACHINERY"]), reads.Condition("state", "like", "%A%"), reads.Condition("class_fills", "from last", 0.1)]
    return reads.filtered(T.scored(s, d).where("in_market"), asked).select("npi", "opportunity", "opportunity_decile", "state")


@query("SELECT volume_decile, opportunity_decile, count(*) AS accounts FROM scored WHERE in_market GROUP BY ALL")
def rq5_stored_aggregate(s: Spark, d: str) -> DataFrame:
    path = f"{_folder(s)}/disagreement"
    files.write_parquet(O.disagreement(T.scored(s, d)), path)
    return files.scan_parquet(s, path, ["volume_decile", "opportunity_decile", "accounts"]).orderBy("volume_decile", "opportunity_decile")


@query("WITH x AS (SELECT npi, class_fills, opportunity FROM scored WHERE in_market ORDER BY (npi * 7919 + 104729) % 1000003, npi LIMIT 200) SELECT string_agg(npi::VARCHAR, ',' ORDER BY npi) AS npi, string_agg(round(class_fills, 2)::VARCHAR, ',' ORDER BY npi) AS class_fills, string_agg(round(opportunity, 2)::VARCHAR, ',' ORDER BY npi) AS opportunity FROM x")
def rq6_tk5_column_sample(s: Spark, d: str) -> DataFrame:
    sample = R.hash_sample(T.scored(s, d).where("in_market"), 200, by=(F.col("npi") * 7919 + 104729) % 1000003)
    columns = reads.column_vectors(sample, ["class_fills", "opportunity"])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x, 2).cast("string")), ",").alias(c)
    return columns.select(F.array_join("npi", ",").alias("npi"), text("class_fills"), text("opportunity"))


@query("SELECT (SELECT count(*) FROM mart WHERE year = 1999) AS served, 1999 AS first_year, 1999 AS last_year, (SELECT count(*) FROM mart) AS analysed")
def rq7_scope(s: Spark, d: str) -> DataFrame:
    m = T.mart(s, d)
    return reads.scope(m.where("year = 1999"), m)


# Contracts

CONTRACT = Q.Contract("market", "opportunity", 10, ("npi", "year"), ("npi", "class_fills"), ("class_fills",), {"brand_share": 0.9}, {"brand_share": (0.0, 1.0)}, ("brand_fills <= class_fills_observed", "suppressed_clms < 0"))


@query("""SELECT 'mart' AS "table", c AS "check", p AS passed, t AS detail FROM (SELECT 'min rows' AS c, count(*) >= 10 AS p, count(*)::VARCHAR AS t FROM mart UNION ALL SELECT 'range brand_share', count(*) FILTER (brand_share < 0 OR brand_share > 1) = 0, (count(*) FILTER (brand_share < 0 OR brand_share > 1))::VARCHAR FROM mart
UNION ALL SELECT 'rule brand_fills <= class_fills_observed', count(*) FILTER (NOT brand_fills <= class_fills_observed) = 0, (count(*) FILTER (NOT brand_fills <= class_fills_observed))::VARCHAR FROM mart UNION ALL SELECT 'rule suppressed_clms < 0', count(*) FILTER (NOT suppressed_clms < 0) = 0, (count(*) FILTER (NOT suppressed_clms < 0))::VARCHAR FROM mart
UNION ALL SELECT 'unique key', count(*) = 0, count(*)::VARCHAR FROM (SELECT npi, year FROM mart GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'null rate brand_share', avg((brand_share IS NULL)::INT) <= 0.9, round(avg((brand_share IS NULL)::INT), 6)::VARCHAR FROM mart UNION ALL SELECT 'column npi', true, 'market -> opportunity' UNION ALL SELECT 'column class_fills', true, 'market -> opportunity' UNION ALL SELECT 'numeric class_fills', true, 'DoubleType()')""")
def dq1_u1_contract(s: Spark, d: str) -> DataFrame:
    return Q.check_contract(s, "mart", materialise(T.mart(s, d)), CONTRACT)


@query("SELECT CASE WHEN s.zip3 < '010' THEN 'SYNTHETIC' ELSE 'REAL' END AS data_mode, count(*) AS rows, false AS passed FROM cust s GROUP BY 1 HAVING (SELECT count(DISTINCT zip3 < '010') FROM cust) = 2 UNION ALL SELECT 'REAL', count(*), true FROM cust HAVING (SELECT count(DISTINCT zip3 < '010') FROM cust) < 2")
def dq2_provenance(s: Spark, d: str) -> DataFrame:
    """Customers of some units are stamped as synthetic: the two must not be used together."""
    c = T.customers(s, d)
    return Q.single_mode(Q.stamp(c.where("zip3 >= '010'"), "REAL"), Q.stamp(c.where("zip3 < '010'"), "SYNTHETIC"))


# Sources, sinks and streams: the driver's tables go through files in the shared folder.


def _csv_rows(s: Spark, d: str) -> str:
    """Product rows as CSV files of Spark's own partitions, renamed to ``rows_<part>_<year>.csv``."""
    base = _folder(s)
    T.all_rows(s, d).select("npi", "year", "product", "tot_clms").write.partitionBy("year").option("header", True).csv(f"{base}/parts")
    hadoop, conf = s._jvm.org.apache.hadoop.fs, s._jsc.hadoopConfiguration()
    folder = hadoop.Path(f"{base}/csv_2001")
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    for k, status in enumerate(fs.globStatus(hadoop.Path(f"{base}/parts/year=*/part-*.csv"))):
        path = status.getPath()
        fs.rename(path, hadoop.Path(folder, f"rows_{k}_{path.getParent().getName().split('=')[1]}.csv"))
    return f"{base}/csv_2001"


@query("SELECT npi::VARCHAR AS npi, product, tot_clms::VARCHAR AS tot_clms, year FROM rows_")
def sc1_yearly_csv(s: Spark, d: str) -> DataFrame:
    return files.scan_yearly_csv(s, _csv_rows(s, d), ["npi", "product", "tot_clms"])


@query("SELECT count(*) AS n, sum(tot_clms) AS clms FROM rows_")
def sc2_permissive_csv(s: Spark, d: str) -> DataFrame:
    r = files.scan_permissive_csv(s, _csv_rows(s, d), ["npi", "product", "tot_clms"])
    return r.agg(F.count("*").alias("n"), F.sum(X.number(F.col("tot_clms"))).alias("clms"))


@query("SELECT zip3, lat FROM units")
def sc3_typed_key_csv(s: Spark, d: str) -> DataFrame:
    path = f"{_folder(s)}/units"
    files.export_csv(T.units(s, d).select("zip3", "lat"), path)
    return files.scan_csv_typed(s, path, "zip3 string, lat double")


@query("SELECT npi, class_fills FROM mart WHERE year = 1999", "class_fills")
def sc4_sc10_sc11_parquet(s: Spark, d: str) -> DataFrame:
    path = f"{_folder(s)}/mart"
    files.write_parquet(T.mart(s, d), path, ["year"])
    return files.scan_parquet(s, path, ["npi", "class_fills"], [1999])


@query("SELECT c_custkey::VARCHAR AS zcta, avg(c_acctbal) AS stroke, avg(c_acctbal / 2) AS chd FROM customer GROUP BY 1", "stroke chd")
def sc5_long_measures(s: Spark, d: str) -> DataFrame:
    c, path = T.table(s, d, "customer"), f"{_folder(s)}/measures"
    long = c.select(F.col("c_custkey").alias("ZCTA"), F.explode(F.array(F.struct(F.lit("STROKE").alias("MeasureId"), F.col("c_acctbal").alias("Data_Value")), F.struct(F.lit("CHD").alias("MeasureId"), (F.col("c_acctbal") / 2).alias("Data_Value")))).alias("x"))
    files.export_csv(long.select("ZCTA", "x.MeasureId", "x.Data_Value"), path)
    return files.scan_measures(s, path, {"STROKE": "stroke", "CHD": "chd"})


@query("SELECT zip3 AS geoid, lat::VARCHAR AS lat FROM units")
def sc6_gazetteer(s: Spark, d: str) -> DataFrame:
    path = f"{_folder(s)}/gaz"
    T.units(s, d).select(F.concat("zip3", F.lit("  ")).alias("GEOID"), F.concat(F.lit(" "), F.col("lat")).alias("LAT   ")).write.option("header", True).option("sep", "\t").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.scan_gazetteer(s, path)


@query("SELECT npi, year, sum(tot_clms) AS observed_all_clms, 0 AS unreadable FROM rows_ GROUP BY ALL")
def sc7_reduce_totals(s: Spark, d: str) -> DataFrame:
    return files.reduce_product_rows(T.all_rows(s, d), T.CLASS)[1]


@query("SELECT npi, year, product, tot_clms FROM rows_ WHERE product IN ('PROMO', 'STANDARD', 'LARGE')")
def sc7_sc8_class_rows(s: Spark, d: str) -> DataFrame:
    return files.project(files.reduce_product_rows(T.all_rows(s, d), T.CLASS)[0], ["npi", "year", "product", "tot_clms"])


@query("SELECT * FROM (SELECT manufacturer, count(*) AS rows FROM touch2 WHERE manufacturer IN ('MFR_0', 'MFR_3') GROUP BY 1 UNION ALL SELECT 'MFR_9', 0)")
def sc9_filter_by_name(s: Spark, d: str) -> DataFrame:
    names = s.createDataFrame([(" MFR_0 ",), ("MFR_3",), ("MFR_9",)], "manufacturer string")
    return files.filter_by_name(T.touches(s, d), names)[1]


@query("SELECT npi, opportunity FROM scored ORDER BY opportunity DESC, npi LIMIT 40", "opportunity")
def sc12_export(s: Spark, d: str) -> DataFrame:
    path = f"{_folder(s)}/export"
    files.export_csv(R.top_k(T.scored(s, d), "opportunity", 40).select("npi", "opportunity"), path)
    return files.scan_csv_typed(s, path, "npi long, opportunity double")


@query("SELECT m.npi, m.year, m.class_fills FROM mart m WHERE npi IN (SELECT npi FROM scored ORDER BY opportunity DESC NULLS LAST, npi LIMIT 30)", "class_fills")
def sc13_slim_extract(s: Spark, d: str) -> DataFrame:
    return files.slim_extract(T.scored(s, d), {"mart": T.mart(s, d).select("npi", "year", "class_fills")}, 30)["mart"]


@query("SELECT 'customer_view' AS view, true AS present, c_mktsegment AS part, count(*) AS rows FROM customer GROUP BY ALL UNION ALL SELECT 'nothing', false, NULL, NULL")
def sc15_views(s: Spark, d: str) -> DataFrame:
    """Registered views are read back by name; a missing one is reported."""
    found = files.register_views(s, {"customer_view": f"{d}/customer.parquet", "nothing": f"{d}/nothing.parquet"})
    rows = s.table("customer_view").groupBy(F.col("c_mktsegment").alias("part")).agg(F.count("*").alias("rows")).withColumn("view", F.lit("customer_view"))
    return found.join(rows, "view", "left").select("view", "present", "part", "rows")


@query("SELECT c_custkey::VARCHAR AS zcta, c_acctbal AS stroke, c_acctbal / 2 AS chd FROM customer", "stroke chd")
def sc5_wide_measures(s: Spark, d: str) -> DataFrame:
    path = f"{_folder(s)}/wide"
    files.export_csv(T.table(s, d, "customer").select(F.col("c_custkey").alias("ZCTA"), F.col("c_acctbal").alias("Stroke"), (F.col("c_acctbal") / 2).alias("CHD")), path)
    return files.scan_measures(s, path, {"STROKE": "stroke", "CHD": "chd"})


@query("SELECT npi, year, product, tot_clms FROM rows_")
def st1_incremental_ingest(s: Spark, d: str) -> DataFrame:
    base = _folder(s)
    rows = T.all_rows(s, d).select("npi", "year", "product", "tot_clms")
    for part in (rows.where("year < 2000"), rows.where("year = 2000")):  # the second run takes only the new files
        part.write.mode("append").parquet(f"{base}/in")
        ingest.ingest(ingest.read_files(s, f"{base}/in", rows.schema), f"{base}/out", f"{base}/log")
    return s.read.parquet(f"{base}/out")


@query("SELECT npi, year, sum(tot_clms) AS tot_clms, count(*) AS rows FROM rows_ GROUP BY ALL")
def st2_running_totals(s: Spark, d: str) -> DataFrame:
    base = _folder(s)
    rows = T.all_rows(s, d).select("npi", "year", "product", "tot_clms")
    rows.write.parquet(f"{base}/in")
    ingest.running_totals(ingest.read_files(s, f"{base}/in", rows.schema, per_trigger=4), f"{base}/out", f"{base}/log")
    return ingest.latest_totals(s, f"{base}/out")
