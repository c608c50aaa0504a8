"""Global ranks, deciles and prefix sums that need no single-partition window.

Rows are range-partitioned and sorted by the order, and numbered inside their partition; running sums are cumulated in
the same pass. Then the totals of the partitions before are added: one row per partition is ordered globally, and no row
is shuffled a second time. Carry keys and order columns only, and join the rest back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import materialise

_ROW_BITS = 33  # of ``monotonically_increasing_id``: the row in its partition


def _cumulate(columns: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replace columns by their running sums over the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = dict.fromkeys(columns, 0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = dict(zip(batch.schema.names, batch.columns, strict=True))
            for c in columns:
                summed = last[c] + np.cumsum(arrays[c].to_numpy(zero_copy_only=False))
                last[c], arrays[c] = float(summed[-1]), pa.array(summed, pa.float64())
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return run


def global_scan(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, rank: str | None = "rn", total: str | None = None) -> DataFrame:
    """Add a global row number ``rank`` and running sums (named like the keys of ``sums``), and the number of rows as ``total``.

    ``order`` has to be total for a repeatable result: end it with a key.
    """
    sums = sums or {}
    plain = {f"__s{k}": F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in enumerate(sums.values())}
    ranged = df.withColumns(plain).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row_id", F.monotonically_increasing_id())
    if plain:
        ranged = ranged.mapInArrow(_cumulate(list(plain)), ranged.schema)
    ranged = materialise(ranged).withColumn("__part", F.shiftright("__row_id", _ROW_BITS))
    per = ranged.groupBy("__part").agg(F.count("*").alias("__n"), *[F.max_by(c, "__row_id").alias(f"{c}_t") for c in plain])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.sum("__n").over(everything).alias("__all"), *[F.coalesce(F.sum(f"{c}_t").over(before), F.lit(0.0)).alias(f"{c}_0") for c in plain])
    out = ranged.join(F.broadcast(offsets), "__part")  # one row per partition
    added = {name: F.col(f"{c}_0") + F.col(c) for name, c in zip(sums, plain, strict=True)}
    if rank:
        added[rank] = F.col("__n0") + F.col("__row_id").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    if total:
        added[total] = F.col("__all")
    return out.withColumns(added).drop("__part", "__row_id", "__n0", "__all", *plain, *[f"{c}_0" for c in plain])


def quantile(df: DataFrame, value: str, p: float = 0.5, name: str = "quantile") -> DataFrame:
    """One row: the exact, interpolated quantile of a column; null without values.

    Equal values are counted first and the counts are scanned in order, so no task holds all distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__c"))
    scan = global_scan(counts, [F.col(value).asc()], {"__upto": F.col("__c")}, rank=None)
    n = counts.agg(F.sum("__c").alias("__n"))
    at = (F.col("__n") - 1) * F.lit(p)
    has = lambda place: (F.col("__upto") > place) & (F.col("__upto") - F.col("__c") <= place)  # noqa: E731  places count from 0
    ends = scan.join(F.broadcast(n)).agg(F.max(F.when(has(F.floor(at)), F.col(value))).alias("a"), F.max(F.when(has(F.ceil(at)), F.col(value))).alias("b"), F.max(at - F.floor(at)).alias("w"))  # one row
    return ends.select((F.col("a") + F.col("w") * (F.col("b") - F.col("a"))).alias(name))


def _ranked(df: DataFrame, value: str, key: str) -> DataFrame:
    """``df`` with ``__rn`` and ``__total``; only the key (unique and not null) and the value are scanned."""
    narrow = df.select(key, value) if key != value else df.select(key)
    scan = global_scan(narrow, [F.col(value).asc_nulls_first(), F.col(key)], rank="__rn", total="__total")
    return scan if set(df.columns) == {key, value} else df.join(scan.select(key, "__rn", "__total"), key)


def decile(df: DataFrame, value: str, name: str, key: str = "npi", buckets: int = 10) -> DataFrame:
    """Equal-count buckets, the highest value in the last: ceil(rank / n * buckets). Ties go by key."""
    bucket = F.least(F.greatest(F.ceil(F.col("__rn") / F.col("__total") * buckets), F.lit(1)), F.lit(buckets)).cast("int")
    return _ranked(df, value, key).withColumn(name, bucket).drop("__rn", "__total")


def quantile_cut(df: DataFrame, value: str, name: str, key: str = "npi", buckets: int = 10) -> DataFrame:
    """Buckets by equal-width cuts of the ranks: ceil((rank - 1) / (n - 1) * buckets), at least 1."""
    cut = F.ceil(F.coalesce(F.try_divide(F.col("__rn") - 1, F.col("__total") - 1), F.lit(0.0)) * buckets)
    return _ranked(df, value, key).withColumn(name, F.greatest(cut, F.lit(1)).cast("int")).drop("__rn", "__total")


def percent_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank of ties over the number of rows with a value; null for null.

    Equal values are counted first, so the global scan is over distinct values and a tie never needs one partition.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__c"))
    ranked = global_scan(counts, [F.col(value).asc()], {"__below": F.col("__c")}, rank=None)
    n = counts.agg(F.sum("__c").alias("__n"))
    ranks = ranked.join(F.broadcast(n)).select(F.col(value).alias("__v"), ((F.col("__below") - F.col("__c") + (F.col("__c") + 1) / 2) / F.col("__n")).alias(name))
    return df.join(ranks, df[value] == F.col("__v"), "left").drop("__v")


def top_k(df: DataFrame, value: str, k: int, key: str = "npi") -> DataFrame:
    """The k largest, ties by key."""
    return df.orderBy(F.col(value).desc_nulls_last(), F.col(key)).limit(k)


def rank_within(df: DataFrame, by: Sequence[str], order: list[Column], sums: dict[str, Column] | None = None, rank: str = "rn", total: str | None = None) -> DataFrame:
    """Row numbers and running sums inside groups, from one scan in the order of groups and values: no group has to fit a task.

    What a group starts with is taken off; the table of groups (few: rules, draws, bands) is broadcast below the session's threshold.
    """
    sums = sums or {}
    scan = global_scan(df, [*[F.col(c) for c in by], *order], sums, rank=rank)
    at_start = [F.min_by(F.col(c) - F.coalesce(x.cast("double"), F.lit(0.0)), rank).alias(f"__0{c}") for c, x in sums.items()]
    starts = scan.groupBy(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)]).agg((F.min(rank) - 1).alias("__start"), F.count("*").alias("__size"), *at_start)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by)])
    out = scan.join(starts, same).withColumns({rank: F.col(rank) - F.col("__start")} | {c: F.col(c) - F.col(f"__0{c}") for c in sums})
    if total:
        out = out.withColumn(total, F.col("__size"))
    return out.drop("__start", "__size", *[f"__by{k}" for k in range(len(by))], *[f"__0{c}" for c in sums])


#: A longest list that is cut in every task before it is shuffled (the session's window group limit).
SHORT = 1000


def top_k_by_rule(stacked: DataFrame, k: int, rule: str = "rule", score: str = "score", key: str = "npi") -> DataFrame:
    """The k largest of each rule with their ``position``.

    Of a short list each task hands on its own k largest, so a rule's last sort has k rows a task; long lists are scanned globally.
    """
    order = [F.col(score).desc_nulls_last(), F.col(key)]
    if k > SHORT:
        return rank_within(stacked, [rule], order, rank="position").where(F.col("position") <= k)
    ranked = stacked.withColumn("position", F.row_number().over(Window.partitionBy(rule).orderBy(*order)))
    return ranked.where(F.col("position") <= k).withColumn("position", F.col("position").cast("long"))


def hash_sample(df: DataFrame, n: int, key: str = "npi", seed: int = 7, by: Column | None = None) -> DataFrame:
    """Exactly n rows (or all), the same for the same keys whatever the partitions; in the order of a hash of the key or of ``by``."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)) if by is None else by, F.col(key)).limit(n)
