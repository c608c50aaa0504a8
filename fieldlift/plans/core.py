"""Queries of expressions, joins, aggregations, windows, lists and market operators over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import backtest as B
from ..operators import market as M
from ..operators import opportunity as O
from ..operators import ranks as R
from . import fixture as T
from .registry import query

Spark = SparkSession


@query("SELECT npi, upper(trim(last_name)) AS name, zip3, substr(lpad(regexp_replace('0' || zip3 || '-1234', '-.*', ''), 5, '0'), 1, 3) AS z3, lpad(regexp_replace(zip3 || '5-678', '[^0-9]', '', 'g'), 5, '0') AS z5_sql FROM cust")
def pr1_pr2_normalise(s: Spark, d: str) -> DataFrame:
    c = T.customers(s, d)
    raw = F.concat(F.lit("0"), F.col("zip3"), F.lit("-1234"))
    return c.select("npi", X.clean(F.col("last_name")).alias("name"), "zip3", X.zip3(raw).alias("z3"), X.zip5(F.concat("zip3", F.lit("5-678")), cut_at_dash=False).alias("z5_sql"))


@query("SELECT event_id, try_cast(trim(event_type) AS DOUBLE) AS as_number, try_cast(regexp_extract(props, '\"k\": *(\\d+)', 1) AS BIGINT) AS k, coalesce(value, 0) + coalesce(try_cast(event_type AS DOUBLE), 0) AS band_sum FROM events", "band_sum")
def pr3_pr4_casts(s: Spark, d: str) -> DataFrame:
    e = T.table(s, d, "events")
    kind = X.number(F.col("event_type"))
    return e.select("event_id", kind.alias("as_number"), X.number(F.regexp_extract("props", r'"k": *(\d+)', 1), "bigint").alias("k"), X.sum_of([F.col("value"), kind]).alias("band_sum"))


@query("SELECT CASE WHEN product IN ('PROMO', 'LARGE') THEN 'BIG' WHEN product = 'SMALL' THEN 'LITTLE' ELSE 'OTHER' END AS product_group, count(*) AS n, count(*) FILTER (product IN ('PROMO', 'STANDARD', 'LARGE')) AS in_class FROM rows_ GROUP BY 1")
def pr5_pr7_categories(s: Spark, d: str) -> DataFrame:
    r = T.all_rows(s, d)
    g = X.collapse(F.col("product"), {"BIG": ["PROMO", "LARGE"], "LITTLE": ["SMALL"]}, "OTHER")
    return r.groupBy(g.alias("product_group")).agg(F.count("*").alias("n"), F.count_if(F.col("product").isin(*T.CLASS)).alias("in_class"))


@query("SELECT npi, year, CASE WHEN class_fills_observed > 0 THEN brand_fills / class_fills_observed END AS r, CASE WHEN class_fills_prior IS NOT NULL THEN (class_fills - class_fills_prior) / greatest(class_fills_prior, 1) END AS g FROM mart", "r g")
def pr6_guarded_ratios(s: Spark, d: str) -> DataFrame:
    return T.mart(s, d).select("npi", "year", X.ratio(F.col("brand_fills"), F.col("class_fills_observed")).alias("r"), X.growth(F.col("class_fills"), F.col("class_fills_prior")).alias("g"))


@query("SELECT product, count(*) AS n, count(*) FILTER (regexp_matches(product, '(GENERIC|PROMO)')) AS hits, count(*) FILTER (nature ILIKE '%FOOD%') AS food FROM touch2 GROUP BY 1")
def pr8_pr9_product_match(s: Spark, d: str) -> DataFrame:
    p = X.product_pattern(["PROMO"], ["generic name"])
    return T.touches(s, d).groupBy("product").agg(F.count("*").alias("n"), F.count_if(F.upper("product").rlike(p)).alias("hits"), F.count_if(F.col("nature").ilike("%FOOD%")).alias("food"))


@query("SELECT npi, greatest(risk_score, NULL, 1.2) AS g, least(risk_score, NULL, 1.5) AS l, ceil(risk_score * 3)::DOUBLE AS c FROM cust", "g l c")
def pr10_extremes(s: Spark, d: str) -> DataFrame:
    none = F.lit(None).cast("double")
    return T.customers(s, d).select("npi", F.greatest("risk_score", none, F.lit(1.2)).alias("g"), F.least("risk_score", none, F.lit(1.5)).alias("l"), F.ceil(F.col("risk_score") * 3).cast("double").alias("c"))


@query("SELECT npi, year, ln(1 + panel_benes) AS log_panel_benes, exp(ln(1 + non_class_clms)) - 1 AS back, coalesce(region, 'Unknown') AS region FROM mart WHERE year = 1999", "log_panel_benes back")
def pr11_d7_features(s: Spark, d: str) -> DataFrame:
    f, _ = O.feature_frame(T.mart(s, d).where(F.col("year") == T.FIT))
    return f.select("npi", "year", "log_panel_benes", F.expm1("log_non_class_clms").alias("back"), "region")


@query("SELECT npi, least(greatest(class_fills, 10), 100) AS fixed, least(greatest(class_fills, lo), hi) AS wins FROM mart, (SELECT quantile_cont(class_fills, 0.01) AS lo, quantile_cont(class_fills, 0.99) AS hi FROM mart WHERE year = 1999) WHERE year = 1999", "fixed wins")
def pr12_clip(s: Spark, d: str) -> DataFrame:
    m = T.mart(s, d).where(F.col("year") == T.FIT)
    q = m.agg(F.percentile("class_fills", 0.01).alias("lo"), F.percentile("class_fills", 0.99).alias("hi"))
    return m.join(F.broadcast(q)).select("npi", X.clip(F.col("class_fills"), 10.0, 100.0).alias("fixed"), X.clip(F.col("class_fills"), F.col("lo"), F.col("hi")).alias("wins"))


@query("""SELECT CASE WHEN opportunity_decile >= 9 THEN 'Decile 9-10' WHEN opportunity_decile >= 7 THEN 'Decile 7-8' ELSE 'Decile 1-6' END AS decile_band, CASE WHEN coalesce(brand_share, 0) < 0.2 THEN 'Low (<20%)' WHEN brand_share < 0.5 THEN 'Mid (20-50%)' ELSE 'High (>50%)' END AS share_band,
  CASE WHEN class_fills < 50 THEN '<50' WHEN class_fills < 200 THEN '50-199' WHEN class_fills < 800 THEN '200-799' ELSE '800+' END AS size_band, count(*) AS n FROM scored GROUP BY ALL""")
def pr13_bands(s: Spark, d: str) -> DataFrame:
    return T.scored(s, d).groupBy(X.decile_band(F.col("opportunity_decile")).alias("decile_band"), X.share_band(F.col("brand_share")).alias("share_band"), X.size_band(F.col("class_fills")).alias("size_band")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN substr(state, 1, 2) IN ('CT','ME','MA','NH','RI','VT','NJ','NY','PA') THEN 'Northeast' WHEN substr(state, 1, 2) IN ('IL','IN','MI','OH','WI','IA','KS','MN','MO','NE','ND','SD') THEN 'Midwest' WHEN substr(state, 1, 2) IN ('DE','DC','FL','GA','MD','NC','SC','VA','WV','AL','KY','MS','TN','AR','LA','OK','TX') THEN 'South' WHEN substr(state, 1, 2) IN ('AZ','CO','ID','MT','NV','NM','UT','WY','AK','CA','HI','OR','WA') THEN 'West' ELSE 'Unknown' END AS region, pop_density < 100 AS rural, count(*) AS n FROM units GROUP BY ALL")
def pr14_regions(s: Spark, d: str) -> DataFrame:
    return T.units(s, d).groupBy(X.census_region(F.substring("state", 1, 2)).alias("region"), (F.col("pop_density") < 100).alias("rural")).agg(F.count("*").alias("n"))


@query("SELECT a.zip3 AS a, b.zip3 AS b, 2 * 3958.7613 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS miles FROM units a JOIN units b ON a.region = b.region AND a.zip3 < b.zip3", "miles")
def pr15_great_circle(s: Spark, d: str) -> DataFrame:
    u = T.units(s, d)
    a, b = u.alias("a"), u.alias("b")
    return a.join(b, (F.col("a.region") == F.col("b.region")) & (F.col("a.zip3") < F.col("b.zip3"))).select(F.col("a.zip3").alias("a"), F.col("b.zip3").alias("b"), X.miles(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("miles"))


@query("SELECT npi, opportunity, opportunity_decile FROM scored WHERE opportunity_decile BETWEEN 5 AND 10 AND specialty_group IN ('BUILDING', 'MACHINERY') AND npi::VARCHAR LIKE '1%' AND lat BETWEEN 30 AND 36 AND lon BETWEEN -110 AND -90", "opportunity")
def pr16_pr17_pr18_filters(s: Spark, d: str) -> DataFrame:
    f = X.account_filter(deciles=(5, 10), groups=["BUILDING", "MACHINERY"], key_prefix="1")
    return T.scored(s, d).where(f & F.col("lat").between(30, 36) & F.col("lon").between(-110, -90)).select("npi", "opportunity", "opportunity_decile")


@query("SELECT npi, 'class size ' || printf('%.2f', class_fills + 0.001) AS text FROM scored WHERE in_market AND class_fills < 50")
def pr19_readable(s: Spark, d: str) -> DataFrame:
    return T.scored(s, d).where("in_market and class_fills < 50").select("npi", F.format_string("class size %.2f", F.col("class_fills") + 0.001).alias("text"))


@query("SELECT npi, opportunity * 0.28 * calls / (12 + calls) AS captured FROM (SELECT npi, opportunity, opportunity_decile::DOUBLE AS calls FROM scored)", "captured")
def pr20_response(s: Spark, d: str) -> DataFrame:
    return T.scored(s, d).select("npi", (F.col("opportunity") * X.hill(F.col("opportunity_decile").cast("double"), 0.28, 12.0)).alias("captured"))


@query("SELECT * FROM obs")
def j1_full_outer(s: Spark, d: str) -> DataFrame:
    sc = T.scripts(s, d)
    in_class = F.col("is_in_class")
    seen = sc.groupBy("npi", "year").agg(F.sum(F.when(in_class, F.col("tot_clms")).otherwise(0.0)).alias("observed_class_clms"), F.count("*").alias("observed_rows"), F.count_if(in_class).alias("observed_class_rows"), F.count_distinct(F.when(in_class, F.col("product"))).alias("observed_class_generics"))
    return M.all_totals(sc).join(seen, ["npi", "year"], "full_outer")


@query("SELECT manufacturer, parent, count(*) AS n FROM touch2 GROUP BY ALL")
def j4_dimension_default(s: Spark, d: str) -> DataFrame:
    return T.touches(s, d).groupBy("manufacturer", "parent").agg(F.count("*").alias("n"))


@query("SELECT manufacturer, count(*) AS rows FROM touch2 WHERE parent = 'UNMAPPED' GROUP BY ALL")
def j4_j9_unmapped(s: Spark, d: str) -> DataFrame:
    return M.unmapped(T.touches(s, d).drop("parent"), T.manufacturers(s), "manufacturer")


@query("SELECT a.npi, a.class_fills AS now, b.class_fills AS after FROM mart a JOIN mart b ON a.npi = b.npi AND a.year = 1999 AND b.year = 2000", "now after")
def j6_period_join(s: Spark, d: str) -> DataFrame:
    m = T.mart(s, d)
    return m.where("year = 1999").select("npi", F.col("class_fills").alias("now")).join(m.where("year = 2000").select("npi", F.col("class_fills").alias("after")), "npi")


@query("SELECT npi, max(class_fills) FILTER (year = 1998) AS y1998, max(class_fills) FILTER (year = 1999) AS y1999, max(class_fills) FILTER (year = 2000) AS y2000 FROM mart GROUP BY npi HAVING count(*) = 3", "y1998 y1999 y2000")
def j7_three_periods(s: Spark, d: str) -> DataFrame:
    p = T.mart(s, d).groupBy("npi").pivot("year", list(T.YEARS)).agg(F.first("class_fills"))
    return p.select("npi", *[F.col(str(y)).alias(f"y{y}") for y in T.YEARS]).dropna()


@query("SELECT count(*) AS n, sum(class_fills) AS fills FROM mart WHERE npi IN (SELECT npi FROM touch)", "fills")
def j8_semi(s: Spark, d: str) -> DataFrame:
    return T.mart(s, d).join(T.touches(s, d).select("npi"), "npi", "left_semi").agg(F.count("*").alias("n"), F.sum("class_fills").alias("fills"))


@query("SELECT (SELECT count(DISTINCT npi) FROM touch) AS payees, (SELECT count(DISTINCT t.npi) FROM touch t SEMI JOIN provider p ON p.npi = t.npi) AS linked, (SELECT count(DISTINCT t.npi) FROM touch t SEMI JOIN provider p ON p.npi = t.npi) / (SELECT count(DISTINCT npi) FROM touch) AS link_rate", "link_rate")
def j10_link_rate(s: Spark, d: str) -> DataFrame:
    return M.link_rate(T.touches(s, d), T.provider(s, d))


@query("SELECT * FROM vol", "class_cost")
def ag1_class_volume(s: Spark, d: str) -> DataFrame:
    return M.class_volume(T.scripts(s, d))


@query("SELECT * FROM pay", "pay_total pay_focus pay_competitor pay_food pay_services")
def ag3_d6_promotion_mart(s: Spark, d: str) -> DataFrame:
    return T.payments(s, d)


@query("SELECT npi, min(year) FILTER (pay_focus > 0) AS first_focus_year, min(year) FILTER (pay_total > 0) AS first_any_year, sum(pay_focus) AS lifetime_focus FROM pay GROUP BY npi", "lifetime_focus")
def ag4_payment_onset(s: Spark, d: str) -> DataFrame:
    return M.payment_onset(T.payments(s, d))


@query("SELECT * FROM bench", "achievable_share")
def ag5_j3_peer_benchmark(s: Spark, d: str) -> DataFrame:
    return M.peer_benchmark(T.mart(s, d))


@query("SELECT year, avg(has_suppression::INT) AS affected_share, sum(suppressed_clms) / sum(all_drug_clms) AS hidden_share FROM supp GROUP BY year", "affected_share hidden_share")
def ag6_suppression_headline(s: Spark, d: str) -> DataFrame:
    return M.suppression_headline(T.suppression(s, d))


@query("SELECT CASE WHEN all_drug_clms < 5 THEN '<5' WHEN all_drug_clms < 15 THEN '5-14' WHEN all_drug_clms < 30 THEN '15-29' ELSE '30+' END AS claims_band, count(*) AS accounts, sum(suppressed_clms) / sum(all_drug_clms) AS hidden_share FROM supp GROUP BY 1", "hidden_share")
def ag6_suppression_by_size(s: Spark, d: str) -> DataFrame:
    return M.suppression_by_size(T.suppression(s, d), [0, 5, 15, 30], ["<5", "5-14", "15-29", "30+"])


@query("SELECT i.year, sum(class_fills_ev - class_fills_observed) / sum(class_fills_ev) AS imputed_share, avg((i.suppressed_clms * i.observed_class_frac > s.hidden_class_clms_cap)::INT) AS cap_binding_rate FROM imp i JOIN supp s ON i.npi = s.npi AND i.year = s.year WHERE class_fills_ev > 0 GROUP BY i.year", "imputed_share cap_binding_rate")
def ag7_imputation_audit(s: Spark, d: str) -> DataFrame:
    return M.imputation_audit(T.imputed(s, d), T.suppression(s, d))


@query("SELECT * FROM supp", "observed_class_frac")
def d1_d3_reconcile_suppression(s: Spark, d: str) -> DataFrame:
    return T.suppression(s, d)


@query("SELECT * FROM imp", "observed_class_frac class_fills_ev class_fills_max")
def d2_impute_class_volume(s: Spark, d: str) -> DataFrame:
    return T.imputed(s, d)


@query("SELECT year, 'zero' AS mode, sum(class_fills_zero) AS class_fills FROM imp GROUP BY year UNION ALL SELECT year, 'ev', sum(class_fills_ev) FROM imp GROUP BY year UNION ALL SELECT year, 'max', sum(class_fills_max) FROM imp GROUP BY year", "class_fills")
def d2_imputation_sensitivity(s: Spark, d: str) -> DataFrame:
    return M.imputation_sensitivity(T.imputed(s, d))


@query("SELECT * FROM mart", "risk_score class_fills brand_share class_fills_prior brand_share_prior class_growth_yoy brand_growth_yoy brand_share_delta zip3_pop_density")
def d4_j2_w3_account_metrics(s: Spark, d: str) -> DataFrame:
    return T.mart(s, d)


@query("""WITH z AS (SELECT c_custkey AS zcta, lpad(c_nationkey::VARCHAR, 3, '0') AS zip3, c_mktsegment AS state, 30.0 + c_custkey % 10 AS lat, -100.0 + c_custkey % 7 AS lon, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE (c_custkey % 100)::DOUBLE END AS population, (1 + c_custkey % 3)::DOUBLE AS land, CASE WHEN c_custkey % 5 > 0 THEN abs(c_acctbal) END AS prev FROM customer),
w AS (SELECT *, greatest(population, 1.0) AS w FROM z), m AS (SELECT zip3, state, row_number() OVER (PARTITION BY zip3 ORDER BY count(*) DESC, state) AS r FROM w GROUP BY zip3, state),
u AS (SELECT zip3, sum(lat * w) / sum(w) AS lat, sum(lon * w) / sum(w) AS lon, sum(prev * w) / sum(w) FILTER (prev IS NOT NULL) AS prev, sum(population) AS population, sum(land) AS land, count(*) AS zctas FROM w GROUP BY zip3)
SELECT u.* REPLACE (coalesce(prev, (SELECT median(prev) FROM u)) AS prev), m.state, population / nullif(land, 0) AS pop_density, population / nullif(land, 0) < 100 AS rural FROM u JOIN m ON m.zip3 = u.zip3 AND r = 1""", "lat lon prev pop_density")
def d5_ag8_ag9_unit_geography(s: Spark, d: str) -> DataFrame:
    c, k = T.table(s, d, "customer"), F.col("c_custkey")
    gaz = c.select(k.alias("zcta"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("zip3"), F.col("c_mktsegment").alias("state"), (30.0 + k % 10).alias("lat"), (-100.0 + k % 7).alias("lon"), F.when(k % 11 == 0, 0.0).otherwise((k % 100).cast("double")).alias("population"), (1.0 + k % 3).alias("land"))
    prev = c.select(k.alias("zcta"), F.when(k % 5 > 0, F.abs("c_acctbal")).alias("prev"))
    return M.unit_geography(gaz, prev, ["prev"])


@query("SELECT npi, class_fills, opportunity, opportunity_pct_of_potential, achievable_share, potential_class, in_market, opportunity_decile, volume_decile, decile_shift FROM scored", "class_fills opportunity opportunity_pct_of_potential achievable_share potential_class")
def d11_j5_w1_score_opportunity(s: Spark, d: str) -> DataFrame:
    return T.scored(s, d).select("npi", "class_fills", "opportunity", "opportunity_pct_of_potential", "achievable_share", "potential_class", "in_market", "opportunity_decile", "volume_decile", "decile_shift")


@query("""WITH f AS (SELECT ln(1 + panel_benes) AS log_panel_benes, ln(1 + non_class_clms) AS log_non_class_clms, risk_score, class_fills, brand_share FROM mart WHERE year = 1999 AND class_fills > 0),
x AS (SELECT 'log_panel_benes' AS feature, false AS forbidden_name, corr(log_panel_benes, class_fills) AS corr FROM f UNION ALL SELECT 'log_non_class_clms', false, corr(log_non_class_clms, class_fills) FROM f UNION ALL SELECT 'risk_score', false, corr(risk_score, class_fills) FROM f UNION ALL SELECT 'brand_share', true, corr(brand_share, class_fills) FROM f)
SELECT *, forbidden_name OR coalesce(abs(corr) > 0.97, false) AS leaks FROM x""", "corr")
def d8_leakage(s: Spark, d: str) -> DataFrame:
    f, _ = O.feature_frame(T.mart(s, d).where("year = 1999 and class_fills > 0"))
    return O.leakage(f, ["log_panel_benes", "log_non_class_clms", "risk_score", "brand_share"], "class_fills")


@query("SELECT npi, (ro / n + rv / n) / 2 AS hybrid FROM (SELECT npi, rank() OVER (ORDER BY opportunity) + (count(*) OVER (PARTITION BY opportunity) - 1) / 2 AS ro, rank() OVER (ORDER BY class_fills) + (count(*) OVER (PARTITION BY class_fills) - 1) / 2 AS rv, count(*) OVER () AS n FROM scored WHERE in_market)", "hybrid")
def d12_w2_hybrid_score(s: Spark, d: str) -> DataFrame:
    return O.hybrid(T.scored(s, d)).select("npi", "hybrid")


@query("SELECT volume_decile, opportunity_decile, count(*) AS accounts FROM scored WHERE in_market GROUP BY ALL")
def ag11_disagreement(s: Spark, d: str) -> DataFrame:
    return O.disagreement(T.scored(s, d))


@query("SELECT count(*) AS accounts, avg((decile_shift = 0)::INT) AS same_decile, avg((abs(decile_shift) <= 1)::INT) AS within_1, avg((abs(decile_shift) >= 2)::INT) AS moved_2_plus, avg(decile_shift) AS mean_shift FROM scored WHERE in_market", "same_decile within_1 moved_2_plus mean_shift")
def ag11_agreement(s: Spark, d: str) -> DataFrame:
    return O.agreement(T.scored(s, d))


@query("SELECT npi, class_fills, greatest(ceil((row_number() OVER (ORDER BY class_fills, npi) - 1) / (count(*) OVER () - 1) * 10), 1)::INT AS cut FROM scored WHERE in_market", "class_fills")
def w1b_quantile_cut(s: Spark, d: str) -> DataFrame:
    return R.quantile_cut(T.scored(s, d).where("in_market").select("npi", "class_fills"), "class_fills", "cut")


@query("SELECT npi, row_number() OVER w AS rn, sum(class_fills) OVER w AS running FROM mart WHERE year = 1999 WINDOW w AS (ORDER BY class_fills DESC, npi ROWS UNBOUNDED PRECEDING)", "running")
def w4_w9_global_scan(s: Spark, d: str) -> DataFrame:
    m = T.mart(s, d).where("year = 1999").select("npi", "class_fills")
    return R.global_scan(m, [F.col("class_fills").desc(), F.col("npi")], {"running": F.col("class_fills")}).select("npi", "rn", "running")


@query("SELECT npi, product, tot_clms - max(tot_clms) OVER (PARTITION BY npi) AS regret, count(*) OVER (PARTITION BY npi) AS products FROM rows_ WHERE year = 1999")
def w7_group_transform(s: Spark, d: str) -> DataFrame:
    w = Window.partitionBy("npi")
    return T.all_rows(s, d).where("year = 1999").select("npi", "product", (F.col("tot_clms") - F.max("tot_clms").over(w)).alias("regret"), F.count("*").over(w).alias("products"))


@query("SELECT npi, product, tot_cost, r AS position FROM (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY abs(tot_cost) DESC, product) AS r FROM rows_ WHERE year = 1999) WHERE r <= 2", "tot_cost")
def w8_top_per_account(s: Spark, d: str) -> DataFrame:
    w = Window.partitionBy("npi").orderBy(F.abs("tot_cost").desc(), "product")
    return T.all_rows(s, d).where("year = 1999").withColumn("position", F.row_number().over(w)).where("position <= 2").select("npi", "product", "tot_cost", "position")


@query("SELECT npi, opportunity FROM scored ORDER BY opportunity DESC, npi LIMIT 100", "opportunity")
def tk1_top_k(s: Spark, d: str) -> DataFrame:
    return R.top_k(T.scored(s, d), "opportunity", 100).select("npi", "opportunity")


@query("SELECT npi, brand_share, (SELECT count(*) FROM scored WHERE in_market) AS total FROM scored WHERE in_market ORDER BY brand_share DESC NULLS LAST, npi LIMIT 50 OFFSET 100", "brand_share")
def tk3_page(s: Spark, d: str) -> DataFrame:
    from ..operators import reads

    return reads.page(T.scored(s, d).where("in_market"), "brand_share", page=3, size=50).select("npi", "brand_share", "total")


@query("SELECT DISTINCT c_custkey AS npi, l_suppkey AS practice FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey")
def so3_sc14_distinct_membership(s: Spark, d: str) -> DataFrame:
    o = T.table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("npi"))
    return T.table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("npi", F.col("l_suppkey").alias("practice")).distinct()


@query("SELECT npi, year FROM provider WHERE year = 1999 INTERSECT SELECT npi, 1999 FROM touch")
def so4_intersect(s: Spark, d: str) -> DataFrame:
    return T.provider(s, d).where("year = 1999").select("npi", "year").intersect(T.touches(s, d).select("npi", F.lit(1999).alias("year")))


@query("SELECT npi FROM provider WHERE year = 1999 EXCEPT SELECT npi FROM provider WHERE year = 2000")
def so4_subtract(s: Spark, d: str) -> DataFrame:
    p = T.provider(s, d)
    return p.where("year = 1999").select("npi").subtract(p.where("year = 2000").select("npi"))


@query("SELECT npi, year, 'a' AS part, class_fills, NULL::DOUBLE AS pay_total FROM mart WHERE year = 1998 UNION ALL SELECT npi, year, 'b', NULL, pay_total FROM pay", "class_fills pay_total")
def so1_so2_union_by_name(s: Spark, d: str) -> DataFrame:
    a = T.mart(s, d).where("year = 1998").select("npi", "year", F.lit("a").alias("part"), "class_fills")
    return a.unionByName(T.payments(s, d).select("npi", "year", F.lit("b").alias("part"), "pay_total"), allowMissingColumns=True)


@query("SELECT npi, brand_growth_abs, brand_growth_pct, share_growth, flagged FROM hold", "brand_growth_abs brand_growth_pct share_growth")
def d23_holdout_frame(s: Spark, d: str) -> DataFrame:
    return T.holdout(s, d).select("npi", "brand_growth_abs", "brand_growth_pct", "share_growth", "flagged")


@query("""SELECT rule, decile, count(*) AS n, avg(brand_growth_abs) AS mean_growth_abs, median(brand_growth_abs) AS median_growth_abs, sum(brand_growth_abs) AS total_growth_abs, avg(share_growth) AS mean_share_growth
FROM (SELECT 'opportunity' AS rule, opportunity_decile AS decile, * FROM hold UNION ALL SELECT 'volume', volume_decile, * FROM hold) GROUP BY ALL""", "mean_growth_abs median_growth_abs total_growth_abs mean_share_growth")
def d24_ag12_decile_lift(s: Spark, d: str) -> DataFrame:
    return B.decile_lift(T.holdout(s, d))


@query("SELECT corr(a, b) AS spearman FROM (SELECT rank() OVER (ORDER BY opportunity) + (count(*) OVER (PARTITION BY opportunity) - 1) / 2 AS a, rank() OVER (ORDER BY brand_growth_abs) + (count(*) OVER (PARTITION BY brand_growth_abs) - 1) / 2 AS b FROM hold)", "spearman")
def ag13_spearman(s: Spark, d: str) -> DataFrame:
    return B.spearman(T.holdout(s, d), "opportunity", "brand_growth_abs")


@query("""WITH n AS (SELECT count(*) AS n, greatest(floor(0.2 * count(*)), 1) AS k, sum(greatest(brand_growth_abs, 0)) AS ta, sum(greatest(coalesce(share_growth, 0), 0)) AS ts FROM hold),
t AS (SELECT 'opportunity' AS rule, row_number() OVER (ORDER BY opportunity DESC, npi) AS r, * FROM hold UNION ALL SELECT 'volume', row_number() OVER (ORDER BY class_fills DESC, npi), * FROM hold)
SELECT rule, any_value(k)::INT AS n_budget, any_value(n)::INT AS universe, sum(greatest(brand_growth_abs, 0)) AS growth_captured, sum(greatest(brand_growth_abs, 0)) / any_value(ta) AS pct_of_growth, sum(greatest(brand_growth_abs, 0)) / any_value(k) AS growth_per_account, sum(greatest(coalesce(share_growth, 0), 0)) AS share_growth_captured,
 sum(greatest(coalesce(share_growth, 0), 0)) / any_value(ts) AS pct_of_share_growth, avg(share_growth) AS mean_share_growth, median(class_fills) AS median_base_fills FROM t, n WHERE r <= k GROUP BY rule""", "growth_captured pct_of_growth growth_per_account share_growth_captured pct_of_share_growth mean_share_growth median_base_fills")
def d25_head_to_head(s: Spark, d: str) -> DataFrame:
    return B.head_to_head(T.holdout(s, d))


@query("""WITH c AS (SELECT *, greatest(ceil((row_number() OVER (ORDER BY class_fills, npi) - 1) / (count(*) OVER () - 1) * 20), 1) AS st FROM hold),
p AS (SELECT st, count(*) FILTER (flagged) AS nt, count(*) FILTER (NOT flagged) AS nc, avg(brand_growth_abs) FILTER (flagged) AS a1, avg(brand_growth_abs) FILTER (NOT flagged) AS a0, avg(share_growth) FILTER (flagged) AS s1, avg(share_growth) FILTER (NOT flagged) AS s0 FROM c GROUP BY st)
SELECT count(*) AS strata, sum(nt)::BIGINT AS treated, sum(a1 * nt) / sum(nt) AS brand_growth_abs_flagged, sum(a0 * nt) / sum(nt) AS brand_growth_abs_other, sum(s1 * nt) / sum(nt) AS share_growth_flagged, sum(s0 * nt) / sum(nt) AS share_growth_other FROM p WHERE nt >= 5 AND nc >= 5""", "brand_growth_abs_flagged brand_growth_abs_other share_growth_flagged share_growth_other")
def d26_ag14_stratified(s: Spark, d: str) -> DataFrame:
    return B.stratified_comparison(T.holdout(s, d))


@query("SELECT npi, brand_growth_abs, opportunity_decile FROM hold WHERE opportunity_decile <= 5 AND brand_growth_abs > 0 ORDER BY brand_growth_abs DESC, npi LIMIT 50", "brand_growth_abs")
def d27_tk4_biggest_misses(s: Spark, d: str) -> DataFrame:
    return B.biggest_misses(T.holdout(s, d)).select("npi", "brand_growth_abs", "opportunity_decile")


@query("SELECT specialty_group, a AS share_all, coalesce(p, 0) AS share_part, coalesce(p, 0) - a AS difference FROM (SELECT specialty_group, count(*) / (SELECT count(*) FROM hold) AS a FROM hold GROUP BY 1) LEFT JOIN (SELECT specialty_group, count(*) / sum(count(*)) OVER () AS p FROM (SELECT * FROM hold WHERE opportunity_decile <= 5 AND brand_growth_abs > 0 ORDER BY brand_growth_abs DESC, npi LIMIT 50) GROUP BY 1) USING (specialty_group)", "share_all share_part difference")
def tk4_over_represented(s: Spark, d: str) -> DataFrame:
    h = T.holdout(s, d)
    return B.over_represented(B.biggest_misses(h), h, "specialty_group")


def _panel(s: Spark, d: str) -> DataFrame:
    m = T.mart(s, d)
    return B.growth_panel(T.scored(s, d), m.where("year = 2000"), m.where("year = 1998"))


PANEL = """panel AS (SELECT s.*, coalesce(n.brand_fills, 0) - s.brand_fills AS growth_abs, coalesce(n.brand_share, 0) - coalesce(s.brand_share, 0) AS growth_share, s.brand_fills - coalesce(b.brand_fills, 0) AS momentum, coalesce(s.zip3_pop_density < 100, false) AS rural
 FROM scored s LEFT JOIN mart n ON n.npi = s.npi AND n.year = 2000 LEFT JOIN mart b ON b.npi = s.npi AND b.year = 1998 WHERE s.class_fills > 0)"""


@query(f"WITH {PANEL} SELECT npi, growth_abs, growth_share, momentum, rural FROM panel", "growth_abs growth_share momentum")
def d29_growth_panel(s: Spark, d: str) -> DataFrame:
    return _panel(s, d).select("npi", "growth_abs", "growth_share", "momentum", "rural")


RULES = f"""{PANEL}, t AS (SELECT 'opportunity' AS rule, row_number() OVER (ORDER BY opportunity DESC, npi) AS r, * FROM panel UNION ALL SELECT 'volume', row_number() OVER (ORDER BY class_fills DESC, npi), * FROM panel UNION ALL SELECT 'momentum', row_number() OVER (ORDER BY momentum DESC, npi), * FROM panel),
rules AS (SELECT rule, sum(greatest(growth_abs, 0)) / (SELECT sum(greatest(growth_abs, 0)) FROM panel) AS abs_capture, sum(greatest(growth_share, 0)) / (SELECT sum(greatest(growth_share, 0)) FROM panel) AS share_capture, avg(growth_share) AS mean_share_growth, avg(class_fills) AS mean_base, median(class_fills) AS median_base, sum(class_fills) AS total_base, sum(growth_abs) AS net_growth FROM t WHERE r <= 150 GROUP BY rule)"""
RULE_COLUMNS = {"opportunity": "opportunity", "volume": "class_fills", "momentum": "momentum"}


@query(f"WITH {RULES} SELECT * FROM rules", "abs_capture share_capture mean_share_growth mean_base median_base total_base net_growth")
def d31_evaluate_rules(s: Spark, d: str) -> DataFrame:
    return B.evaluate_rules(_panel(s, d), RULE_COLUMNS, 150)


@query(f"""WITH {RULES}, x AS (SELECT *, abs_capture >= 0.9 * (SELECT abs_capture FROM rules WHERE rule = 'volume') AS clears_floor, median_base < 0.25 * (SELECT median_base FROM rules WHERE rule = 'volume') AS metric_gamed FROM rules)
SELECT *, rule = coalesce((SELECT rule FROM x WHERE clears_floor AND rule IN ('opportunity', 'volume') ORDER BY share_capture DESC, rule LIMIT 1), 'volume') AS recommended FROM x""", "abs_capture share_capture mean_share_growth mean_base median_base total_base net_growth")
def d32_recommend_rule(s: Spark, d: str) -> DataFrame:
    return B.recommend_rule(B.evaluate_rules(_panel(s, d), RULE_COLUMNS, 150), ["opportunity", "volume"])


WEIGHTS = [round(0.05 * k, 2) for k in range(21)]
BLEND = f"""{PANEL}, r AS (SELECT npi, growth_abs, growth_share, (rank() OVER (ORDER BY opportunity) + (count(*) OVER (PARTITION BY opportunity) - 1) / 2) / count(*) OVER () AS ro, (rank() OVER (ORDER BY class_fills) + (count(*) OVER (PARTITION BY class_fills) - 1) / 2) / count(*) OVER () AS rv FROM panel),
s AS (SELECT w AS weight, npi, greatest(growth_abs, 0) AS a, greatest(growth_share, 0) AS s, row_number() OVER (PARTITION BY w ORDER BY round(w * ro + (1 - w) * rv, 12) DESC, npi) AS p FROM r, (SELECT unnest({WEIGHTS})::DOUBLE AS w)),
g AS (SELECT weight, sum(a) AS a, sum(s) AS s FROM s WHERE p <= 150 GROUP BY weight), blend AS (SELECT weight, a / (SELECT a FROM g WHERE weight = 0) AS abs_ratio, s / (SELECT s FROM g WHERE weight = 0) AS share_ratio, a / (SELECT a FROM g WHERE weight = 0) >= 0.9 AS clears_floor FROM g)"""


@query(f"WITH {BLEND} SELECT * FROM blend", "abs_ratio share_ratio")
def d33_blend_frontier(s: Spark, d: str) -> DataFrame:
    return B.blend_frontier(_panel(s, d), 150, WEIGHTS)


@query(f"WITH {BLEND} SELECT coalesce((SELECT weight FROM blend WHERE clears_floor ORDER BY share_ratio DESC, weight LIMIT 1), 0) AS weight", "weight")
def d33_choose_weight(s: Spark, d: str) -> DataFrame:
    return B.choose_weight(B.blend_frontier(_panel(s, d), 150, WEIGHTS))


@query(f"""WITH {PANEL}, n AS (SELECT count(*) AS n FROM panel), v AS (SELECT 'opportunity' AS rule, npi, opportunity AS sc, greatest(growth_abs, 0) AS g FROM panel UNION ALL SELECT 'volume', npi, class_fills, greatest(growth_abs, 0) FROM panel),
c AS (SELECT rule, row_number() OVER w AS rn, sum(g) OVER w AS cum, sum(g) OVER (PARTITION BY rule) AS tot FROM v WINDOW w AS (PARTITION BY rule ORDER BY sc DESC, npi ROWS UNBOUNDED PRECEDING))
SELECT rule, p AS point, rn / n AS list_share, cum / tot AS captured FROM c, n, range(1, 39) t(p) WHERE rn = ceil(p * n / 38)""", "list_share captured")
def ev3_w5_gain_curve(s: Spark, d: str) -> DataFrame:
    p = _panel(s, d).withColumn("g", F.greatest("growth_abs", F.lit(0.0)))
    return B.gain_curve(p, {"opportunity": "opportunity", "volume": "class_fills"}, "g")


@query("""WITH a AS (SELECT avg((abs(decile_shift) >= 2)::INT) AS moved FROM scored WHERE in_market), l AS (SELECT opportunity_decile AS k, avg(brand_growth_abs) AS m FROM hold GROUP BY 1),
r AS (SELECT corr(x, y) AS rho FROM (SELECT rank() OVER (ORDER BY k) + 0.0 AS x, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS y FROM l)),
t AS (SELECT rule, h.*, row_number() OVER (PARTITION BY rule ORDER BY CASE rule WHEN 'v' THEN class_fills ELSE opportunity END DESC, npi) AS p FROM hold h, (VALUES ('o'), ('v')) x(rule)), k AS (SELECT greatest(floor(0.2 * count(*)), 1) AS k FROM hold),
g AS (SELECT sum(greatest(coalesce(share_growth, 0), 0)) FILTER (rule = 'o') / sum(greatest(coalesce(share_growth, 0), 0)) FILTER (rule = 'v') AS s, median(class_fills) FILTER (rule = 'o') / median(class_fills) FILTER (rule = 'v') AS b FROM t, k WHERE p <= k)
SELECT 'G2 moves deciles' AS gate, moved >= 0.3 AS passed FROM a UNION ALL SELECT 'G3 ranks growth', coalesce(rho >= 0.6, false) FROM r UNION ALL SELECT 'G3 beats volume on share', coalesce(s >= 1.05, false) FROM g UNION ALL SELECT 'G3 base not gamed', coalesce(b >= 0.25, false) FROM g UNION ALL SELECT 'G4 contiguity', false UNION ALL SELECT 'G4 balance', false""")
def d28_gates(s: Spark, d: str) -> DataFrame:
    """Without an alignment: what isn't measured fails."""
    h = T.holdout(s, d)
    return B.gates(O.agreement(T.scored(s, d)), B.decile_lift(h), B.head_to_head(h))
