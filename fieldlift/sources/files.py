"""File sources and sinks: yearly CSV files, permissive scans, wide or long releases, one-pass reductions, extracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def scan_yearly_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All-text scan; the year is in the file name, ``..._2023.csv``, never in the folder's."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(strings(columns)).csv(paths)
    return df.withColumn("year", F.regexp_extract("_metadata.file_name", r"_(\d{4})\.csv$", 1).try_cast("int"))


def union_layouts(frames: Sequence[DataFrame]) -> DataFrame:
    """Files of different layouts by column name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scan_permissive_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All-text scan that drops malformed lines; typed later."""
    return spark.read.option("header", True).option("mode", "DROPMALFORMED").schema(strings(columns)).csv(paths)


def scan_csv_typed(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Keys such as ZIP3 keep their leading zeros through an explicit schema."""
    return spark.read.option("header", True).schema(schema).csv(paths)


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str], years: Sequence[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return (df.where(F.col("year").isin(*years)) if years else df).select(*columns)


def scan_measures(spark: SparkSession, path: str, measures: Mapping[str, str], key: str = "zcta") -> DataFrame:
    """Wide or long release of the same measures, told apart by the header. ``measures``: name in the file to result column."""
    df = spark.read.option("header", True).csv(path)
    columns = {c.lower(): c for c in df.columns}
    ident = F.col(columns[key]).alias(key)
    if "measureid" in columns:
        rows = df.select(ident, F.col(columns["measureid"]).alias("m"), F.col(columns["data_value"]).try_cast("double").alias("v"))
        wide = rows.groupBy(key).pivot("m", list(measures)).agg(F.avg("v"))
        return wide.withColumnsRenamed(dict(measures))
    return df.select(ident, *[F.col(columns[m.lower()]).try_cast("double").alias(out) for m, out in measures.items()])


def scan_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with padded column names."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    return df.toDF(*[c.strip().lower() for c in df.columns]).select(*[F.trim(c.strip().lower()).alias(c.strip().lower()) for c in df.columns])


def reduce_product_rows(rows: DataFrame, class_products: Sequence[str], value: str = "tot_clms") -> tuple[DataFrame, DataFrame]:
    """Class rows, and totals over all rows with a count of unreadable values: totals are never taken after the filter."""
    typed = rows.withColumn("__v", F.trim(F.col(value).cast("string")).try_cast("double"))
    bad = F.col("__v").isNull() & F.col(value).isNotNull()
    totals = typed.groupBy("npi", "year").agg(F.sum("__v").alias("observed_all_clms"), F.count_if(bad).alias("unreadable"))
    return typed.where(F.col("product").isin(*class_products)).drop(value).withColumnRenamed("__v", value), totals


def project(rows: DataFrame, columns: Sequence[str], key: str = "npi") -> DataFrame:
    return rows.where(F.col(key).isNotNull()).select(*columns)


def filter_by_name(rows: DataFrame, names: DataFrame, column: str = "manufacturer") -> tuple[DataFrame, DataFrame]:
    """Rows of the configured names (exact after trimming), and the rows per configured name, those without any as well."""
    wanted = names.select(F.trim(column).alias("__name")).distinct()
    hits = rows.join(wanted, F.trim(rows[column]) == F.col("__name"), "left_semi")
    counts = hits.groupBy(F.trim(column).alias("__name")).agg(F.count("*").alias("rows"))
    return hits, wanted.join(counts, "__name", "left").fillna(0, ["rows"]).withColumnRenamed("__name", column)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> dict[str, int]:
    """Write and report the shape, which is observed during the write and costs no second pass."""
    from pyspark.sql import Observation

    seen = Observation("shape")
    w = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)
    return {"rows": seen.get["rows"], "columns": len(df.columns)}


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def slim_extract(lead: DataFrame, tables: Mapping[str, DataFrame], n: int, by: str = "opportunity", key: str = "npi") -> dict[str, DataFrame]:
    """The n leading accounts, applied to every account-level table; tables without the key are whole."""
    keep = lead.orderBy(F.desc_nulls_last(by), F.col(key)).limit(n).select(key)
    return {name: t.join(keep, key, "left_semi") if key in t.columns else t for name, t in tables.items()}


def register_views(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """A view per path that can be read; the others are reported as missing."""
    found = []
    for name, path in paths.items():
        try:
            spark.read.parquet(path).createOrReplaceTempView(name)
            found.append((name, True))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found.append((name, False))
    return spark.createDataFrame(found, "view string, present boolean")
