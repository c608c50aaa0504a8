"""Behavioural segments: trajectory features, choice of the number of clusters, profiles and label scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import materialise
from . import models, ranks, stats

#: Features of the clusters.
FEATURES = ("brand_share", "share_delta_recent", "share_delta_prior", "log_class_fills", "class_growth", "log_payments", "opportunity_pct")
#: Numbers of clusters tried, draws and their size.
CANDIDATES, RUNS, PART = (3, 4, 5, 6, 7, 8), 25, 0.8
#: Fixed value: accounts that the silhouette is taken over.
SILHOUETTE_ROWS = 4_000


def panel(scored: DataFrame, payments: DataFrame, years: Sequence[int]) -> DataFrame:
    """A row per account in the market of the last year with its trajectory over three years; what is missing counts as no change.

    ``scored``: npi, year, brand_share, class_fills, opportunity_pct_of_potential.
    """
    first, middle, last = years
    wide = scored.groupBy("npi").pivot("year", list(years)).agg(F.first("brand_share").alias("share"), F.first("class_fills").alias("fills"), F.first("opportunity_pct_of_potential").alias("opp"))
    paid = payments.groupBy("npi").agg(F.sum("pay_total").alias("paid"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share, fills = (lambda y: F.col(f"{y}_share")), (lambda y: F.col(f"{y}_fills"))
    rows = wide.where(zero(fills(last)) > 0).join(paid, "npi", "left")
    return rows.select(
        "npi",
        zero(share(last)).alias("brand_share"),
        zero(share(last) - share(middle)).alias("share_delta_recent"),
        zero(share(middle) - share(first)).alias("share_delta_prior"),
        F.log1p(zero(fills(last))).alias("log_class_fills"),
        zero((fills(last) - fills(middle)) / F.when(fills(middle).isNotNull(), F.greatest(fills(middle), F.lit(1.0)))).alias("class_growth"),
        F.log1p(zero(F.col("paid"))).alias("log_payments"),
        zero(F.col(f"{last}_opp")).alias("opportunity_pct"),
    )


def standardised(rows: DataFrame) -> DataFrame:
    """``rows`` with the vector ``z`` of standardised features."""
    steps = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="__v"), StandardScaler(inputCol="__v", outputCol="z", withMean=True)])
    return materialise(steps.fit(rows).transform(rows).drop("__v"))


def clusters(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return KMeans(k=k, seed=seed, featuresCol="z", predictionCol="cluster").fit(rows).transform(rows)


def agreement(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency counts."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = pairs.groupBy(*by, a, b).agg(F.count("*").alias("__c"))
    side = lambda x: cells.groupBy(*by, x).agg(F.sum("__c").alias("__s")).groupBy(*by).agg(F.sum(two("__s")).alias(f"s_{x}"))
    t = cells.groupBy(*by).agg(F.sum(two("__c")).alias("both"), F.sum("__c").alias("n"))
    for part in (side(a), side(b)):
        t = t.join(part, list(by)) if by else t.join(F.broadcast(part))  # one row
    expected = F.try_divide(F.col(f"s_{a}") * F.col(f"s_{b}"), two("n"))
    return t.select(*by, F.coalesce(F.try_divide(F.col("both") - expected, (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2 - expected), F.lit(1.0)).alias("ari"))


def silhouette(labelled: DataFrame, names: Sequence[str], rows: int = SILHOUETTE_ROWS) -> DataFrame:
    """``name, silhouette``: mean Euclidean silhouette of each column of labels over a hashed sample of the accounts.

    The sample has ``rows`` accounts at most, so it is sent to all tasks; each of them takes the distances of its part of the
    sample to the whole, a batch at a time, once for all labellings. An account alone in its cluster has 0.
    """
    sample = materialise(ranks.hash_sample(labelled, rows).select(vector_to_array("z").alias("z"), *names))
    all_ = sample.toArrow()  # at most ``rows`` rows
    if not all_.num_rows:
        return labelled.sparkSession.createDataFrame([(n, None) for n in names], "name string, silhouette double")
    z = np.array(all_["z"].to_pylist())
    whole = labelled.sparkSession.sparkContext.broadcast((z, {n: np.unique(all_[n].to_numpy(), return_inverse=True)[1] for n in names}, {n: np.unique(all_[n].to_numpy()) for n in names}))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, codes, known = whole.value
        for b in (whole_batch.slice(at, 256) for whole_batch in batches for at in range(0, whole_batch.num_rows, 256)):
            mine = np.array(b.column("z").to_pylist()).reshape(-1, points.shape[1])
            far = np.sqrt(np.square(mine[:, None, :] - points[None]).sum(2))
            out = {}
            for n in names:
                size = np.bincount(codes[n])
                sums = np.stack([np.bincount(codes[n], d, len(size)) for d in far]) if len(far) else np.empty((0, len(size)))
                own = np.searchsorted(known[n], b.column(n).to_numpy())
                every = np.arange(len(own))
                inner = sums[every, own] / np.maximum(size[own] - 1, 1)
                mean = sums / size
                mean[every, own] = np.inf
                outer = mean.min(1) if len(size) > 1 else np.full(len(own), np.nan)
                out[n] = np.where(size[own] > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(names), b.num_rows)), pa.array(np.concatenate([out[n] for n in names]))], names=["name", "s"])

    return sample.repartition(8).mapInArrow(parts, "name string, s double").groupBy("name").agg(F.avg("s").alias("silhouette"))


def choose_k(rows: DataFrame, candidates: Sequence[int] = CANDIDATES, runs: int = RUNS, part: float = PART, seed: int = 42) -> DataFrame:
    """By number of clusters: silhouette, mean and deviation of the agreement with clusterings of hashed parts, inertia and combined rank.

    The silhouettes of all candidates are taken from one pass over a sample; runs fit side by side.
    """
    cut = lambda b: F.pmod(F.xxhash64("npi", F.lit(b)), F.lit(1000)) < int(1000 * part)

    def own(k: int) -> tuple[DataFrame, float]:
        model = KMeans(k=k, seed=seed, featuresCol="z", predictionCol="cluster").fit(rows)
        out = materialise(model.transform(rows).select("npi", "z", "cluster"))
        return out, model.summary.trainingCost

    def again(k: int, b: int) -> DataFrame:
        sub = rows.where(cut(b))
        return KMeans(k=k, seed=seed + b + 1, featuresCol="z", predictionCol="other").fit(sub).transform(sub).select("npi", F.lit(k).alias("k"), F.lit(b).alias("run"), "other")

    whole = dict(zip(candidates, models.in_parallel([lambda k=k: own(k) for k in candidates]), strict=True))
    parts = stats.union_all(models.in_parallel([lambda k=k, b=b: again(k, b) for k in candidates for b in range(runs)]))
    labels = stats.union_all([w.select("npi", "cluster", F.lit(k).alias("k")) for k, (w, _) in whole.items()])
    ari = agreement(parts.join(labels, ["npi", "k"]), "cluster", "other", ["k", "run"]).groupBy("k").agg(F.avg("ari").alias("stability_ari"), F.stddev_pop("ari").alias("stability_sd"))
    facts = rows.sparkSession.createDataFrame([(k, str(k), i) for k, (_, i) in whole.items()], "k int, name string, inertia double")
    wide = materialise(rows.select("npi", "z"))
    for k, (w, _) in whole.items():
        wide = wide.join(w.select("npi", F.col("cluster").alias(str(k))), "npi")
    out = facts.join(silhouette(materialise(wide), [str(k) for k in whole]), "name").join(ari, "k").select("k", "silhouette", "inertia", "stability_ari", "stability_sd")
    best = lambda c: F.rank().over(Window.partitionBy().orderBy(F.desc(c)))  # noqa: E731  a row per candidate
    return out.withColumn("combined_rank", best("silhouette") + best("stability_ari"))


def profile(clustered: DataFrame) -> DataFrame:
    """Centroid, size and share of the universe by cluster."""
    n = clustered.agg(F.count("*").alias("__all"))
    out = clustered.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in FEATURES], F.count("*").alias("accounts"))
    return out.join(F.broadcast(n)).withColumn("share_of_universe", F.col("accounts") / F.col("__all")).drop("__all")  # one row


def label_scores(profiles: DataFrame) -> DataFrame:
    """``cluster, label, score, position``: how much a cluster stands out as each business label; scores above 0 only.

    Centroids are standardised across clusters (population deviation, 1 where it is 0), so a label means most of the
    segments found, not above a constant. ``position`` ranks the clusters of a label.
    """
    used = ("brand_share", "share_delta_recent", "share_delta_prior", "log_class_fills", "opportunity_pct")
    facts = profiles.agg(*[F.avg(c).alias(f"m_{c}") for c in used], *[F.stddev_pop(c).alias(f"s_{c}") for c in used])
    spread = lambda c: F.when(F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) > 0, F.col(f"s_{c}")).otherwise(1.0)
    z = profiles.join(F.broadcast(facts)).select("cluster", *[((F.col(c) - F.col(f"m_{c}")) / spread(c)).alias(c) for c in used])  # one row
    share, recent, prior, volume, room = (F.col(c) for c in used)
    # The labels and what makes a cluster one.
    rules = {
        "Loyal Advocates": share - room - F.abs(recent),
        "Rising Switchers": 2 * recent + prior,
        "Untapped Potential": room - share + 0.5 * volume,
        "Generic Anchors": -share - F.abs(recent),
        "Eroding Base": -2 * recent,
        "Low-Value Tail": -2 * volume,
        "Steady Core": volume - F.abs(recent) - F.abs(share),
    }
    long = z.select("cluster", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), s.alias("score")) for n, s in rules.items()])).alias("x")).select("cluster", "x.label", "x.score").where("score > 0")
    return long.withColumn("position", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "cluster")))
