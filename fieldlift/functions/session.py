"""Materialisation in the shared checkpoint folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fieldlift-checkpoint-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder: fixes its rows and partitions, and survives lost executors."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder and read it again: what a loop uses.

    A checkpoint passes its plan's size estimate on. In a loop of joins these estimates multiply from round to round, until
    planning takes seconds and overflows; a file is as large as it is, and small ones are joined by broadcast.
    """
    spark = df.sparkSession
    path = f"{_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_parallel(fits: Sequence[Callable[[], T]], threads: int = 4) -> list[T]:
    """Results of independent fits. A round's jobs are small, so several drivers' threads submit theirs side by side."""
    with ThreadPool(max(1, min(threads, len(fits)))) as pool:
        return pool.map(inheritable_thread_target(lambda f: f()), fits)
