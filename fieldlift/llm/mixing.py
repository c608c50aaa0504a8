"""Source mixing by temperature: exponentiated token shares, realised as budgeted block permutations.

Weights are token shares to the power ``alpha``, normalised. ``alpha`` is bisected to meet a target entropy of the
weights or a limit of repetitions of any source; sources stay in Spark, and the sums over them that a step needs are
aggregates for a whole grid of exponents, which halves the bracket ``HALVINGS`` times a job. A source's documents are dealt to blocks (about the square root of
its number of documents, so neither the blocks of a source nor the documents of a block grow with the source itself).
An epoch is a keyed permutation of the blocks and of the documents in each. The last epoch stops at the budget: blocks
before it are whole, in the block that crosses it documents are taken in order while they fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialise, word_count

SEED = 17
MAX_REPETITION = 2.0
#: Halvings of the bracket by one aggregation, and in all.
HALVINGS, ROUNDS = 5, 60


@dataclass(frozen=True)
class Temperature:
    alpha: float
    norm: float
    budget: float


def bisect(f: Callable[[list[float]], list[float]], low: float, high: float, target: float) -> float:
    """Where the monotone ``f`` meets ``target`` in [low, high]; the nearer end if it doesn't. ``f`` takes many points at once."""
    first, last = f([low, high])
    rising, n = last >= first, 1 << HALVINGS
    for _ in range(ROUNDS // HALVINGS):
        points = [low + (high - low) * k / n for k in range(n + 1)]
        below = sum((value < target) == rising for value in f(points[1:-1]))
        low, high = points[below], points[below + 1]
    return (low + high) / 2


def temperature(sources: DataFrame, *, budget_tokens: float | None = None, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None) -> Temperature:
    """``sources``: a row per source with its tokens ``t``. Only sums over them reach the driver.

    Without a budget it is the smallest that gives every source at least one whole epoch, so no document is lost.
    """
    held = sources.where("t > 0").select(F.col("t").cast("double").alias("t"))
    total, least, most = held.agg(F.sum("t"), F.min("t"), F.max("t")).first()
    if total is None:
        return Temperature(1.0, 1.0, 0.0)
    log_share = F.log(F.col("t") / F.lit(total))

    def sums(alphas: list[float]) -> list[tuple[float, float]]:
        """Sums of the shares' powers, and of the powers times the logarithms of the shares."""
        power = [F.exp(F.lit(a) * log_share) for a in alphas]
        got = held.agg(*[F.sum(p) for p in power], *[F.sum(p * log_share) for p in power]).first()
        return list(zip(got[: len(alphas)], got[len(alphas) :], strict=True))

    def entropy(alphas: list[float]) -> list[float]:
        return [math.log(z) - a * e / z for a, (z, e) in zip(alphas, sums(alphas), strict=True)]

    def repetition(alphas: list[float]) -> list[float]:
        """The largest weight * budget / tokens, which is the smallest source's for exponents of at most 1."""
        if budget_tokens is None:
            return [(most / least) ** (1 - a) for a in alphas]
        return [budget_tokens * (least / total) ** a / z / least for a, (z, _) in zip(alphas, sums(alphas), strict=True)]

    if target_entropy is not None:
        alpha = bisect(entropy, 0.0, 4.0, target_entropy)
    elif max_repetition is not None:
        alpha = bisect(repetition, 0.0, 1.0, max_repetition)
    else:
        alpha = 1.0
    z = sums([alpha])[0][0]
    # The source whose weight is smallest for its tokens decides how much gives every source an epoch.
    poorest = most if alpha <= 1 else least
    budget = float(budget_tokens) if budget_tokens is not None else poorest * z / (poorest / total) ** alpha
    return Temperature(alpha, z * total**alpha, budget)


def _unit(*columns) -> F.Column:
    """A hash of the columns in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def plan(docs: DataFrame, *, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **limits: float | None) -> DataFrame:
    """One row per distinct document (id and text): ``doc_id, h, source, n_tokens, weight, repetition, full, copies, block, r``.

    Tokens are words. Null sources are one source. A source without tokens takes no budget: its documents come once.
    Rows that repeat both id and text are planned once, under the first of their sources by name (null last). An empty
    table gives an empty plan. Texts of any length are counted whole.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("n_tokens"))
    narrow = narrow.groupBy("doc_id", "h").agg(F.min("source").alias("source"), F.min("n_tokens").alias("n_tokens"))
    narrow = materialise(narrow.withColumn("s", F.coalesce("source", F.lit("\0null"))))
    sources = materialise(narrow.groupBy("s").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("docs")))
    heat = temperature(sources, **limits)

    weight = F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(heat.alpha)) / heat.norm).otherwise(0.0)
    sources = sources.withColumn("weight", weight)
    # A repetition within rounding of a whole number is that number, so that a whole epoch isn't cut by the last bit.
    exact = F.when(F.col("t") > 0, F.col("weight") * heat.budget / F.col("t")).otherwise(1.0)
    sources = sources.withColumn("repetition", F.when(F.abs(exact - F.round(exact)) < 1e-9, F.round(exact)).otherwise(exact))
    sources = sources.withColumn("full", F.floor("repetition").cast("int")).withColumn("part", F.round((F.col("repetition") - F.col("full")) * F.col("t")).cast("long")).withColumn("nb", F.ceil(F.sqrt("docs")).cast("int"))
    n_sources = sources.count()
    placed = join_small(narrow, sources, ["s"], n_sources).withColumn("block", F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), "nb").cast("int"))

    blocks = placed.groupBy("s", "full", "part", "block").agg(F.sum("n_tokens").alias("bt"))
    order = _unit("s", "block", "full", F.lit(seed))
    before = F.coalesce(F.sum("bt").over(Window.partitionBy("s").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = materialise(blocks.select("s", "block", (F.col("part") - before).alias("room"), "bt").where("room > 0"))
    whole = placed.join(cut, ["s", "block"], "left")
    inside = whole.where("room < bt")
    used = F.sum("n_tokens").over(Window.partitionBy("s", "block").orderBy(_unit("doc_id", "h", "full", F.lit(seed + 1)), "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0))
    taken = inside.withColumn("more", (used <= F.col("room")).cast("int"))
    rest = whole.where("room is null or room >= bt").withColumn("more", F.col("room").isNotNull().cast("int"))
    columns = ["doc_id", "h", "source", "s", "n_tokens", "weight", "repetition", "full", "block", "nb", (F.col("full") + F.col("more")).alias("copies")]
    return rest.select(*columns).unionByName(taken.select(*columns))


def emissions(planned: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per emitted copy of a document: ``epoch`` and ``position``, by which sorting gives the mixed order.

    Positions of a source are even over [0, 1): its epochs follow one another, in each epoch its blocks in the epoch's
    permutation, in each block its documents in theirs. So sorting interleaves the sources by their weights.
    """
    out = planned.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    blocks = out.select("s", "block", "nb", "epoch").distinct()
    rank = F.row_number().over(Window.partitionBy("s", "epoch").orderBy(_unit("s", "block", "epoch", F.lit(seed)), "block"))
    blocks = blocks.select("s", "block", "epoch", ((rank - 1) / F.col("nb")).alias("at"))
    inner = _unit("doc_id", "h", "epoch", F.lit(seed + 1)) / F.col("nb")
    position = (F.col("epoch") + F.col("at") + inner) / F.greatest("repetition", "copies")
    return out.join(blocks, ["s", "block", "epoch"]).select("doc_id", "source", "n_tokens", "weight", "repetition", "epoch", "block", position.alias("position"))


def mixed_documents(docs: DataFrame, *, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **limits: float | None) -> DataFrame:
    """The rows of ``docs``, with all their columns, as many times as the mix repeats them.

    Columns may have any names; nulls, ties, repeated rows and empty tables are as in ``plan``.
    """
    planned = plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **limits).where("copies > 0")
    # Columns are inside structs, so that none of them clashes.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    chosen = planned.select(F.struct("doc_id", "h", "copies").alias("c"))
    out = rows.join(chosen, F.col("r")[id_col].eqNullSafe(F.col("c.doc_id")) & (F.xxhash64(F.col("r")[text_col]) == F.col("c.h")))
    return out.select("r", F.explode(F.sequence(F.lit(1), F.col("c.copies"))).alias("copy")).select("r.*")
