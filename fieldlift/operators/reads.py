"""Read-side queries: filtered, sorted and paged lists, account detail, exports and call lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import reason_text

#: Columns that a list may be sorted by.
SORTABLE = ("opportunity", "class_fills", "brand_share", "brand_fills", "opportunity_decile", "volume_decile", "decile_shift", "npi")


#: What a condition may ask, as SQL over a column and a parameter.
CONDITIONS = {"=": "{c} = {p}", "<": "{c} < {p}", "<=": "{c} <= {p}", ">": "{c} > {p}", ">=": "{c} >= {p}", "in": "array_contains({p}, {c})", "like": "{c} LIKE {p}", "from last": "{c} >= {p} * (SELECT max({c}) FROM {{rows}})"}


@dataclass(frozen=True)
class Condition:
    """A column, one of ``CONDITIONS`` and a value (a list for ``in``)."""

    column: str
    asks: str
    value: Any


def filtered(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Rows that meet all conditions, by Spark SQL with named parameters.

    Text of a query comes from the schema and from ``CONDITIONS`` alone; values are bound and never become text. An unknown
    column or condition raises. A row with a null in an asked column isn't met; without conditions all rows stay.
    """
    parts, values = [], {}
    for k, c in enumerate(conditions):
        if c.column not in df.columns:
            raise ValueError(f"no column {c.column!r}")
        if c.asks not in CONDITIONS:
            raise ValueError(f"can't ask {c.asks!r}")
        parts.append(CONDITIONS[c.asks].format(c="`" + c.column.replace("`", "``") + "`", p=f":p{k}"))
        values[f"p{k}"] = c.value
    return df.sparkSession.sql("SELECT * FROM {rows}" + (" WHERE " + " AND ".join(parts) if parts else ""), args=values, rows=df)


def page(df: DataFrame, sort: str, *, page: int = 1, size: int = 50, ascending: bool = False, where: Column | None = None) -> DataFrame:
    """One page of a filtered list, nulls last, ties by key, with the total of rows."""
    if sort not in SORTABLE:
        raise ValueError(f"can't sort by {sort!r}")
    rows = df if where is None else df.where(where)
    order = F.col(sort).asc_nulls_last() if ascending else F.col(sort).desc_nulls_last()
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(order, F.col("npi")).offset((page - 1) * size).limit(size).join(F.broadcast(total))


def detail(scored: DataFrame, spine: DataFrame, npi: int, payments: DataFrame | None = None, **more: DataFrame) -> DataFrame:
    """An account's row with its trend and payments over the periods, in order; ``more``: tables of a row or some by account (segment, drivers, forecast, uplift), each as an array of structs."""
    mine = lambda df: df.where(F.col("npi") == npi)
    trend = mine(spine).groupBy("npi").agg(F.array_sort(F.collect_list(F.struct("year", "class_fills", "brand_fills", "brand_share", "class_growth_yoy"))).alias("trend"))
    out = mine(scored).join(trend, "npi", "left")
    if payments is not None:
        paid = mine(payments).groupBy("npi").agg(F.array_sort(F.collect_list(F.struct("year", "pay_total", "pay_count", "pay_companies", "pay_focus", "pay_competitor"))).alias("payments"))
        out = out.join(paid, "npi", "left")
    for name, df in more.items():
        columns = [c for c in df.columns if c != "npi"]
        out = out.join(mine(df).groupBy("npi").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name)), "npi", "left")
    return out


def call_list(plan: DataFrame, assignment: DataFrame, territory: int, drivers: DataFrame | None = None, forecast: DataFrame | None = None) -> DataFrame:
    """A territory's accounts in visiting order: targets first, then by opportunity; with the first driver's reason and the forecast, if given.

    ``drivers``: npi, rank, feature, multiplier and the feature's value; ``forecast``: a row per account.
    """
    rows = plan.join(assignment.select("zip3", "territory"), "zip3").where(F.col("territory") == territory)
    if drivers is not None:
        why = drivers.where("rank = 1").select("npi", reason_text(F.col("feature"), F.col("value"), F.col("multiplier")).alias("why"))
        rows = rows.join(why, "npi", "left")
    if forecast is not None:
        rows = rows.join(forecast, "npi", "left")
    w = Window.partitionBy("territory").orderBy(F.desc("is_target"), F.desc("opportunity"), "npi")
    return rows.withColumn("visit_order", F.row_number().over(w))


def territory_options(plan: DataFrame, assignment: DataFrame) -> DataFrame:
    """Territories with their states in order, accounts and targets."""
    rows = plan.join(assignment.select("zip3", "territory"), "zip3")
    return rows.groupBy("territory").agg(F.array_join(F.sort_array(F.collect_set("state")), ", ").alias("states"), F.count("*").alias("accounts"), F.count_if("is_target").alias("targets"), F.sum("opportunity").alias("opportunity"))


def column_vectors(sample: DataFrame, columns: list[str]) -> DataFrame:
    """One row with an array per column, in key order; for a bounded sample."""
    return sample.agg(F.array_sort(F.collect_list(F.struct("npi", *columns))).alias("rows")).select(*[F.col(f"rows.{c}").alias(c) for c in ("npi", *columns)])


def scope(served: DataFrame, analysed: DataFrame) -> DataFrame:
    return served.agg(F.count("*").alias("served"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).join(F.broadcast(analysed.agg(F.count("*").alias("analysed"))))
