"""Binding of the account-targeting tables to the TPC-H-like tables, in Spark and, for the oracle, in DuckDB SQL.

Accounts are customers, periods the years 1998 to 2000, products part types; rows of fewer than 2 claims are hidden.

A query asks for the mart and what it is made of many times, and its plan would join and group the order lines each time.
Inside ``making`` these tables are written when they are first asked for, and read from there on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import written
from ..operators import market

YEARS = (1998, 1999, 2000)
FIT, HOLDOUT = 1999, 2000
CLASS, FOCUS = ("PROMO", "STANDARD", "LARGE"), ("PROMO",)
THRESHOLD, GENERICS = 2, 3

_made: ContextVar[dict[tuple, DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def making() -> Iterator[None]:
    """The run of one query: its shared tables are made once, and not kept for the next one."""
    token = _made.set({})
    try:
        yield
    finally:
        _made.reset(token)


def once(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(f)
    def kept(spark: SparkSession, d: str, *rest: int) -> DataFrame:
        made, key = _made.get(), (f.__name__, d, *(rest or f.__defaults__ or ()))
        if made is None:
            return f(spark, d, *rest)
        if key not in made:
            made[key] = written(f(spark, d, *rest))
        return made[key]

    return kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@once
def lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines of the three periods, for all that is made of them; the date range reaches the scan of orders."""
    orders = table(spark, d, "orders").where(f"o_orderdate >= timestamp '{YEARS[0]}-01-01' and o_orderdate < timestamp '{YEARS[-1] + 1}-01-01'")
    orders = orders.select("o_orderkey", F.col("o_custkey").alias("npi"), F.year("o_orderdate").alias("year"))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost"))
    parts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("product"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("npi", "year", "product", "l_orderkey", "l_suppkey", "l_quantity", "cost")


@once
def all_rows(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("npi", "year", "product").agg(F.count("*").cast("double").alias("tot_clms"), F.sum("l_quantity").cast("double").alias("tot_fills"), F.sum("cost").alias("tot_cost"))


def scripts(spark: SparkSession, d: str) -> DataFrame:
    return market.flag_products(all_rows(spark, d).where(F.col("tot_clms") >= THRESHOLD), CLASS, FOCUS)


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def units(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return nations(spark, d).select(
        F.lpad(k.cast("string"), 3, "0").alias("zip3"),
        F.col("n_name").alias("state"),
        (30.0 + 2 * (k % 5)).alias("lat"),
        (-110.0 + 6 * F.floor(k / 5)).alias("lon"),
        F.col("r_name").alias("region"),
        (1000.0 * (1 + k)).alias("population"),
        (10.0 * (1 + k % 7)).alias("land"),
        (1000.0 * (1 + k) / (10.0 * (1 + k % 7))).alias("pop_density"),
    )


def customers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("npi"), F.col("c_name").alias("last_name"), F.col("n_name").alias("state"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("zip3"), F.col("c_mktsegment").alias("specialty_group"), F.round(1 + F.abs("c_acctbal") / 10000 + 1e-7, 4).alias("risk_score"), F.col("c_nationkey"))


@once
def provider(spark: SparkSession, d: str) -> DataFrame:
    totals = lines(spark, d).groupBy("npi", "year").agg(F.count("*").cast("double").alias("all_drug_clms"), F.count_distinct("l_orderkey").cast("double").alias("panel_benes"))
    return totals.join(customers(spark, d).drop("c_nationkey"), "npi")


def suppression(spark: SparkSession, d: str) -> DataFrame:
    s = scripts(spark, d)
    return market.reconcile_suppression(provider(spark, d), s, market.all_totals(s), THRESHOLD, GENERICS)


def imputed(spark: SparkSession, d: str) -> DataFrame:
    return market.impute_class_volume(suppression(spark, d), market.class_volume(scripts(spark, d)))


@once
def mart(spark: SparkSession, d: str) -> DataFrame:
    p = provider(spark, d)
    rows = market.observe(p, scripts(spark, d), THRESHOLD, GENERICS)
    return market.spine(rows.select(*p.columns, *market.imputed_volume(), "observed_class_clms").drop("observed_class_frac"), units(spark, d))


def touches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    product = F.when(k < 20, "PROMO").when(k < 40, "STANDARD").otherwise("OTHER")
    rows = e.select(F.col("user_id").cast("long").alias("npi"), (1998 + F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))).cast("int").alias("year"), F.col("value").alias("amount"), F.when(F.col("event_type") == "purchase", "Food and Beverage").otherwise(F.col("event_type")).alias("nature"), F.concat_ws(" | ", product, F.lit(None).cast("string"), F.lit("GENERIC")).alias("product"), F.concat(F.lit("MFR_"), (k % 7).cast("string")).alias("manufacturer"))
    return market.map_dimension(rows, manufacturers(spark), "manufacturer", "parent")


def manufacturers(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("MFR_"), F.col("id").cast("string")).alias("manufacturer"), F.concat(F.lit("PARENT_"), F.col("id").cast("string")).alias("parent"))


def payments(spark: SparkSession, d: str) -> DataFrame:
    return market.promotion_mart(touches(spark, d), "PROMO", "STANDARD")


@once
def scored(spark: SparkSession, d: str, year: int = FIT) -> DataFrame:
    """A period's spine with a cell frontier: potential is the 80th percentile of in-market volume of the group."""
    from ..operators import opportunity

    m = mart(spark, d)
    now = m.where(F.col("year") == year)
    return opportunity.score(now, market.peer_benchmark(m), opportunity.cell_frontier(now))


def holdout(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import backtest

    return backtest.holdout_frame(scored(spark, d), mart(spark, d).where(F.col("year") == HOLDOUT))


BASE = r"""
line_ AS (SELECT o_custkey AS npi, year(o_orderdate)::INT AS year, p_type AS product, l_orderkey, l_suppkey, l_quantity, l_extendedprice * (1 - l_discount) AS cost
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE year(o_orderdate) BETWEEN 1998 AND 2000),
rows_ AS (SELECT npi, year, product, count(*)::DOUBLE AS tot_clms, sum(l_quantity)::DOUBLE AS tot_fills, sum(cost) AS tot_cost FROM line_ GROUP BY ALL),
cust AS (SELECT c_custkey AS npi, c_name AS last_name, n_name AS state, lpad(c_nationkey::VARCHAR, 3, '0') AS zip3, c_mktsegment AS specialty_group, round(1 + abs(c_acctbal) / 10000 + 1e-7, 4) AS risk_score, c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
provider AS (SELECT l.npi, l.year, count(*)::DOUBLE AS all_drug_clms, count(DISTINCT l_orderkey)::DOUBLE AS panel_benes, any_value(last_name) AS last_name, any_value(state) AS state, any_value(zip3) AS zip3, any_value(specialty_group) AS specialty_group, any_value(risk_score) AS risk_score
  FROM line_ l JOIN cust USING (npi) GROUP BY l.npi, l.year),
units AS (SELECT lpad(n_nationkey::VARCHAR, 3, '0') AS zip3, n_name AS state, 30.0::DOUBLE + 2 * (n_nationkey % 5) AS lat, -110.0::DOUBLE + 6 * (n_nationkey // 5) AS lon, r_name AS region, 1000.0::DOUBLE * (1 + n_nationkey) AS population, 10.0::DOUBLE * (1 + n_nationkey % 7) AS land,
  (1000.0::DOUBLE * (1 + n_nationkey)) / (10.0::DOUBLE * (1 + n_nationkey % 7)) AS pop_density FROM nation JOIN region ON n_regionkey = r_regionkey),
face AS (SELECT npi, year, sum(tot_clms) FILTER (shown) AS shown_clms, count(*) FILTER (shown) AS shown_rows, sum(tot_clms) FILTER (shown AND ours) AS ours_clms, count(*) FILTER (shown AND ours) AS ours_rows, sum(tot_fills) FILTER (shown AND ours) AS ours_fills,
    sum(tot_cost) FILTER (shown AND ours) AS ours_cost, coalesce(sum(tot_fills) FILTER (shown AND product = 'PROMO'), 0) AS focus_fills, coalesce(sum(tot_clms) FILTER (shown AND product = 'PROMO'), 0) AS focus_clms
  FROM (SELECT *, tot_clms > 1 AS shown, list_contains(['PROMO', 'STANDARD', 'LARGE'], product) AS ours FROM rows_) GROUP BY npi, year),
vol AS (SELECT npi, year, ours_fills AS class_fills, ours_clms AS class_clms, ours_cost AS class_cost, focus_fills AS brand_fills, focus_clms AS brand_clms, ours_rows AS class_drug_rows FROM face WHERE ours_rows > 0),
obs AS (SELECT npi, year, shown_clms AS observed_all_clms, coalesce(ours_clms, 0) AS observed_class_clms, shown_rows AS observed_rows, ours_rows AS observed_class_rows, ours_rows AS observed_class_generics FROM face WHERE shown_rows > 0),
hid AS (SELECT provider.*, face.* EXCLUDE (npi, year), greatest(all_drug_clms - coalesce(shown_clms, 0), 0) AS hidden, coalesce(ours_clms / shown_clms, 0) AS part, greatest(3 - coalesce(ours_rows, 0), 0)::DOUBLE AS room, coalesce(ours_fills, 0) AS own, coalesce(ours_fills / ours_clms, 1) AS rate FROM provider LEFT JOIN face USING (npi, year)),
supp AS (SELECT npi, year, all_drug_clms, specialty_group, coalesce(shown_clms, 0) AS observed_all_clms, coalesce(ours_clms, 0) AS observed_class_clms, coalesce(shown_rows, 0) AS observed_rows, coalesce(ours_rows, 0) AS observed_class_rows, coalesce(ours_rows, 0) AS observed_class_generics,
  hidden AS suppressed_clms, ceil(hidden) AS suppressed_rows_min, hidden AS suppressed_rows_max, hidden AS suppressed_rows_ev, part AS observed_class_frac, room AS hidden_class_clms_cap, hidden > 0 AS has_suppression FROM hid),
imp AS (SELECT npi, year, own AS class_fills_observed, coalesce(focus_fills, 0) AS brand_fills_observed, coalesce(ours_rows, 0) AS class_drug_rows, hidden AS suppressed_clms, part AS observed_class_frac, own AS class_fills_zero, own + rate * least(room, part * hidden) AS class_fills_ev, own + rate * least(room, hidden) * (part > 0)::INT AS class_fills_max FROM hid),
step AS (SELECT hid.npi, hid.year, hid.last_name, hid.state, hid.zip3, hid.specialty_group, hid.all_drug_clms, hid.panel_benes, hid.risk_score, class_fills_ev AS class_fills, own AS class_fills_observed, brand_fills_observed AS brand_fills, class_drug_rows, hidden AS suppressed_clms, greatest(hid.all_drug_clms - coalesce(ours_clms, 0), 0) AS non_class_clms,
    lat, lon, region, population AS zip3_population, pop_density AS zip3_pop_density, brand_fills_observed / nullif(own, 0) AS brand_share, row_number() OVER (PARTITION BY hid.npi ORDER BY hid.year) AS place FROM hid JOIN imp USING (npi, year) LEFT JOIN units USING (zip3)),
mart AS (SELECT x.* EXCLUDE (place), y.class_fills AS class_fills_prior, y.brand_fills AS brand_fills_prior, y.brand_share AS brand_share_prior, x.class_fills / greatest(y.class_fills, 1) - y.class_fills / greatest(y.class_fills, 1) AS class_growth_yoy, x.brand_fills / greatest(y.brand_fills, 1) - y.brand_fills / greatest(y.brand_fills, 1) AS brand_growth_yoy,
    x.brand_share - y.brand_share AS brand_share_delta, x.brand_fills - y.brand_fills AS brand_fills_abs_growth FROM step x LEFT JOIN step y ON y.npi = x.npi AND y.place + 1 = x.place),
peers AS (SELECT specialty_group, region, year, grouping(region) AS wide, count(*) AS n, quantile_cont(brand_share, 0.75) AS q FROM mart WHERE class_fills > 0 AND brand_share >= 0 GROUP BY GROUPING SETS ((specialty_group, year, region), (specialty_group, year))),
bench AS (SELECT own.specialty_group, own.region, own.year, own.n AS n_peers, if(own.n < 30, whole.q, own.q) AS achievable_share, own.n < 30 AS used_fallback FROM peers own, peers whole WHERE own.wide = 0 AND whole.wide = 1 AND whole.specialty_group = own.specialty_group AND whole.year = own.year),
touch AS (SELECT user_id::BIGINT AS npi, (1998 + least((day(ts) - 1) // 10, 2))::INT AS year, value AS amount, CASE WHEN event_type = 'purchase' THEN 'Food and Beverage' ELSE event_type END AS nature, regexp_extract(props, '"k": *(\d+)', 1)::INT AS k FROM events),
touch2 AS (SELECT *, ['PROMO', 'STANDARD', 'OTHER', 'OTHER', 'OTHER', 'OTHER'][1 + least(k // 20, 5)] || ' | GENERIC' AS product, 'MFR_' || (k % 7) AS manufacturer, if(k % 7 < 5, 'PARENT_' || (k % 7), 'UNMAPPED') AS parent FROM touch),
pay AS (SELECT npi, year, sum(amount) AS pay_total, count(*) AS pay_count, count(DISTINCT nullif(parent, 'UNMAPPED')) AS pay_companies, sum(amount * focus) AS pay_focus, sum(amount * rival) AS pay_competitor, sum(amount * meal) AS pay_food, sum(amount) - sum(amount * meal) AS pay_services, sum(focus)::BIGINT AS focus_events, sum(rival)::BIGINT AS competitor_events, sum(meal)::BIGINT AS food_events
  FROM (SELECT *, (k < 20)::INT AS focus, (k // 20 = 1)::INT AS rival, (nature = 'Food and Beverage')::INT AS meal FROM touch2) WHERE npi IS NOT NULL GROUP BY npi, year),
frontier AS (SELECT specialty_group, quantile_cont(class_fills, 0.8) AS frontier FROM mart WHERE year = 1999 AND class_fills > 0 GROUP BY ALL),
sc0 AS (SELECT m.*, greatest(coalesce(f.frontier, 0), m.class_fills) AS potential_class, b.achievable_share AS a FROM mart m LEFT JOIN frontier f ON m.specialty_group = f.specialty_group LEFT JOIN bench b ON m.specialty_group IS NOT DISTINCT FROM b.specialty_group AND m.region IS NOT DISTINCT FROM b.region AND m.year = b.year WHERE m.year = 1999),
sc1 AS (SELECT * EXCLUDE (a), coalesce(a, (SELECT median(a) FROM sc0)) AS achievable_share, class_fills > 0 AS in_market FROM sc0),
sc2 AS (SELECT *, CASE WHEN in_market THEN potential_class * achievable_share ELSE 0 END AS potential_brand, CASE WHEN in_market THEN greatest(potential_class * achievable_share - brand_fills, 0) ELSE 0 END AS opportunity FROM sc1),
sc3 AS (SELECT *, coalesce(opportunity / nullif(potential_brand, 0), 0) AS opportunity_pct_of_potential,
  CASE WHEN in_market THEN least(greatest(ceil(row_number() OVER (PARTITION BY in_market ORDER BY opportunity, npi) * 10.0 / count(*) OVER (PARTITION BY in_market)), 1), 10)::INT ELSE 0 END AS opportunity_decile,
  CASE WHEN in_market THEN least(greatest(ceil(row_number() OVER (PARTITION BY in_market ORDER BY class_fills, npi) * 10.0 / count(*) OVER (PARTITION BY in_market)), 1), 10)::INT ELSE 0 END AS volume_decile FROM sc2),
scored AS (SELECT *, opportunity_decile - volume_decile AS decile_shift FROM sc3),
hold AS (SELECT s.*, m.class_fills AS class_fills_next, m.brand_fills AS brand_fills_next, m.brand_share AS brand_share_next, m.brand_fills - s.brand_fills AS brand_growth_abs, (m.brand_fills - s.brand_fills) / greatest(s.brand_fills, 5) AS brand_growth_pct, m.brand_share - s.brand_share AS share_growth, s.opportunity_decile >= 8 AS flagged
  FROM scored s JOIN mart m ON m.npi = s.npi AND m.year = 2000 WHERE s.in_market)
"""


def oracle(body: str, rounded: str = "", digits: int = 4) -> str:
    """A query over the bound tables; the named columns are rounded like Spark's doubles."""
    replace = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in rounded.split())
    return f"WITH {BASE} SELECT * {f'REPLACE ({replace}) ' if replace else ''}FROM ({body})"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
