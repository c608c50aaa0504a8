"""Every query of the library by name, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from . import fixture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, rounded: str = "", digits: int = 4) -> Callable[[Query], Query]:
    """Register a query under its name. The doubles named in ``rounded`` are rounded in the SQL, and all of them in Spark."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            with fixture.making():
                return fixture.rounded(f(spark, d), digits)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = fixture.oracle(sql, rounded, digits)
        return f

    return register


for _module in ("core", "study", "modelled", "advanced"):
    import_module(f"{__package__}.{_module}")
