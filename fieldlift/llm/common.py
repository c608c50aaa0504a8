"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as in ``[\x20\x09-\x0D]``; every other code point belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch: whole texts are long, and a Python worker holds a batch at a time.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; the session's Arrow batches are kept small from here on."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only in local mode, where none is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if context.getCheckpointDir() is None:
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = folder or tempfile.mkdtemp(prefix="fieldlift-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder: cuts the lineage and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it again: like ``materialise``, for rows of which later steps read few columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Let Spark's cleaner drop the shuffle and checkpoint files of rounds that nothing refers to any more.

    The cleaner acts when the driver's JVM collects garbage, which a loop of small rounds may not cause for a long time.
    """
    gc.collect()
    df.sparkSession._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_small(left: DataFrame, right: DataFrame, on: list[str], rows: int, limit: int = 10_000) -> DataFrame:
    """Left join that broadcasts ``right`` only if its counted ``rows`` stay below ``limit``; else a shuffle join that AQE can split."""
    return left.join(F.broadcast(right) if rows <= limit else right, on, "left")
