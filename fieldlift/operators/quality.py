"""Declarative data contracts, compiled to one aggregation per table, and provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Contract:
    """What a table has to hold. Rules are SQL boolean expressions; a null outcome passes, as do nulls in ranges."""

    producer: str = ""
    consumer: str = ""
    min_rows: int = 1
    key: Sequence[str] = ()
    columns: Sequence[str] = ()
    numeric: Sequence[str] = ()
    null_rate: Mapping[str, float] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    rules: Sequence[str] = ()


SCHEMA = "table string, check string, passed boolean, detail string"


def check_contract(spark: SparkSession, name: str, df: DataFrame | None, contract: Contract) -> DataFrame:
    """One row per check. A missing table or column is a failed check, not an error."""
    if df is None:
        return spark.createDataFrame([(name, "exists", False, "missing table")], SCHEMA)
    there = set(df.columns)
    fixed = [(name, f"column {c}", c in there, f"{contract.producer} -> {contract.consumer}") for c in contract.columns]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fixed += [(name, f"numeric {c}", c in there and isinstance(kinds[c], T.NumericType), str(kinds.get(c, "missing"))) for c in contract.numeric]
    tests: list[tuple[str, F.Column, F.Column]] = [("min rows", F.count("*") >= contract.min_rows, F.count("*"))]
    for c, cap in contract.null_rate.items():
        if c in there:
            rate = F.avg(F.col(c).isNull().cast("double"))
            tests.append((f"null rate {c}", F.coalesce(rate <= cap, F.lit(True)), F.round(rate, 6)))
    for c, (low, high) in contract.ranges.items():
        if c in there:
            out = F.count_if(F.coalesce((F.col(c) < low) if low is not None else F.lit(False), F.lit(False)) | F.coalesce((F.col(c) > high) if high is not None else F.lit(False), F.lit(False)))
            tests.append((f"range {c}", out == 0, out))
    for rule in contract.rules:
        bad = F.count_if(F.coalesce(~F.expr(rule), F.lit(False)))
        tests.append((f"rule {rule}", bad == 0, bad))
    fields = [F.struct(F.lit(n).alias("check"), ok.alias("passed"), detail.cast("string").alias("detail")) for n, ok, detail in tests]
    out = df.agg(F.array(*fields).alias("x")).select(F.explode("x").alias("x")).select(F.lit(name).alias("table"), "x.check", "x.passed", "x.detail")
    if contract.key:
        twice = df.groupBy(*contract.key).count().where("count > 1").agg(F.count("*").alias("n"))
        out = out.unionByName(twice.select(F.lit(name).alias("table"), F.lit("unique key").alias("check"), (F.col("n") == 0).alias("passed"), F.col("n").cast("string").alias("detail")))
    return out.unionByName(spark.createDataFrame(fixed, SCHEMA)) if fixed else out


def enforce(results: DataFrame) -> None:
    """Raise if any check failed."""
    if bad := [f"{r['table']}: {r['check']} ({r['detail']})" for r in results.where("not passed").collect()]:  # a row per check
        raise ValueError("; ".join(bad))


def stamp(df: DataFrame, mode: str) -> DataFrame:
    return df.withColumn("data_mode", F.lit(mode))


def single_mode(*frames: DataFrame) -> DataFrame:
    """Modes of the frames that are to be used together with their rows, and whether they are one: ``data_mode, rows, passed``. A row per mode."""
    counts = [f.groupBy("data_mode").agg(F.count("*").alias("rows")) for f in frames]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    per = every.groupBy("data_mode").agg(F.sum("rows").alias("rows"))
    return per.join(F.broadcast(per.agg((F.count("*") == 1).alias("passed"))))  # one row
