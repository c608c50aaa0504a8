"""Incremental ingest of files and running totals with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_files(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    r = spark.readStream.format(kind).schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what hasn't been ingested yet and stop. The checkpoint makes it resumable by file, the sink's log atomic."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def running_totals(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Totals by account and year as a stateful sum. Each batch's updated totals are appended with the batch number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    totals = stream.groupBy("npi", "year").agg(F.sum("tot_clms").alias("tot_clms"), F.count("*").alias("rows"))
    q = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    """The last update of each account and year."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy("npi", "year").agg(F.max_by("tot_clms", "batch").alias("tot_clms"), F.max_by("rows", "batch").alias("rows"))
