"""Connected components of an edge table by alternating large-star and small-star steps; every step is a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

SALTS = 8


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of an edge table with the columns ``u, v``.

    Self-loops are ignored; nodes without another edge don't appear. Null ends are dropped. Nothing but a row count and
    a checksum reaches the driver. The edges of a hub are dealt over ``SALTS`` tasks in the step that is keyed by the
    smaller node; in the other a node meets the few nodes that it points to.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        release(now)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("s", F.explode(F.array(*map(F.lit, range(SALTS)))))
        dealt = both.where("v > u").withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        large = dealt.join(low, ["u", "s"]).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialise(small.distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
