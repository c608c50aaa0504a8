"""Toxicity by cumulative-link (proportional odds) ordinal regression on sparse hashed text features.

P(grade >= k) = sigmoid(w.x - c_k): one weight vector is shared by the ordered thresholds c_1 <= c_2 <= c_3. The score
is the expected severity, the sum of P(grade >= k). Labels say toxic or not, so severity grades of the training rows
are derived: 0 for clean rows; toxic rows get 1 to 3 by terciles of the number of their words that are typical of toxic
rows (by document frequency in the sample). The fit takes at most ``max_rows`` labelled documents, those with the smallest
hash of the id: toxic ones up to half of them, clean ones for the rest, weighted by their numbers among the labels.
Scoring covers every document and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import DIMENSIONS, EDGE, HashedFeatures, Rows, sigmoid

MAX_ROWS = 12_000
GRADES = 3
#: Documents with P(grade >= 1) of at least this are rejected.
REJECT_AT = 0.5


def names(word: str) -> list[str]:
    """A word without its edges, and its beginnings, so that unseen endings of a known stem count as well."""
    w = word.strip(EDGE).lower()
    return ["w" + w, "4" + w[:4], "5" + w[:5]] if len(w) > 5 else ["w" + w] if w else []


@dataclass
class Model:
    """Weights that aren't zero, by feature index, and the ordered cut points."""

    index: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(DIMENSIONS)
        w[self.index] = self.weight
        return w

    def survival(self, score: np.ndarray) -> np.ndarray:
        return sigmoid(score[:, None] - self.cuts)


def grades(rows: Rows, toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows; 1 to ``GRADES`` for toxic ones by quantiles of how many typical features they have."""
    bad, good = rows.back(toxic.astype(float), DIMENSIONS), rows.back(1.0 - toxic, DIMENSIONS)
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((1 - toxic).sum() + 1))
    typical = ((odds > 2) & (bad >= 3)).astype(float)
    hits = rows.dot(typical)
    if not toxic.any():
        return np.zeros(rows.n, int)
    edges = np.quantile(hits[toxic == 1], np.arange(1, GRADES) / GRADES)
    return np.where(toxic == 1, 1 + np.searchsorted(edges, hits, side="left"), 0)


def gradient(rows: Rows, grade: np.ndarray, share: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades and its gradient in the weights and cuts; ``share`` are the rows' weights, of sum 1."""
    p = sigmoid(rows.dot(w)[:, None] - cuts)
    # Likelihood of a grade is P(>= k) - P(>= k + 1); its gradient in the score and in each cut point.
    d = p * (1 - p)
    edge = np.c_[np.ones(rows.n), p, np.zeros(rows.n)]
    slope = np.c_[np.zeros(rows.n), d, np.zeros(rows.n)]
    at = np.arange(rows.n)
    mass = np.maximum(edge[at, grade] - edge[at, grade + 1], 1e-9)
    g_score = -(slope[at, grade] - slope[at, grade + 1]) / mass * share
    g_cut = np.zeros((rows.n, len(cuts) + 2))
    g_cut[at, grade] += slope[at, grade] / mass
    g_cut[at, grade + 1] -= slope[at, grade + 1] / mass
    return float(-(share * np.log(mass)).sum()), rows.back(g_score, len(w)), (g_cut[:, 1:-1] * share[:, None]).sum(0)


def fit_rows(features: list[np.ndarray], toxic: np.ndarray, steps: int = 300, l1: float = 2e-4, rate: float = 0.5, toxic_share: float | None = None) -> Model:
    """Proximal AdaGrad on the ordinal likelihood; an L1 penalty keeps weights of uninformative features at zero.

    ``toxic_share``: the share of toxic rows that the weighted sample stands for; as a default that of the rows.
    """
    rows, toxic = Rows(features), np.asarray(toxic, int)
    if rows.n == 0 or toxic.min() == toxic.max():
        return Model(np.empty(0, np.int32), np.empty(0), np.full(GRADES, 40.0 if rows.n == 0 or not toxic.max() else -40.0))
    grade = grades(rows, toxic)
    used = np.flatnonzero(np.bincount(rows.columns, minlength=DIMENSIONS))
    place = np.zeros(DIMENSIONS, np.int32)
    place[used] = np.arange(len(used))
    rows.columns = place[rows.columns]
    toxic_share = toxic.mean() if toxic_share is None else toxic_share
    weight = np.where(toxic == 1, toxic_share / toxic.sum(), (1 - toxic_share) / (1 - toxic).sum())
    w, sum_w = np.zeros(len(used)), np.full(len(used), 1e-8)
    at_least = np.array([weight[grade >= k].sum() for k in range(1, GRADES + 1)]).clip(1e-4, 1 - 1e-4)
    cuts, sum_c = -np.log(at_least / (1 - at_least)), np.full(GRADES, 1e-8)
    for _ in range(steps):
        _, g, g_cuts = gradient(rows, grade, weight, w, cuts)
        sum_w += g * g
        step = rate / np.sqrt(sum_w)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        sum_c += g_cuts * g_cuts
        cuts = np.maximum.accumulate(cuts - rate / np.sqrt(sum_c) * g_cuts)
    kept = np.flatnonzero(w)
    return Model(used[kept].astype(np.int32), w[kept], cuts)


def feature_column(text: Column) -> Column:
    @F.pandas_udf("array<int>")
    def features(texts: pd.Series) -> pd.Series:
        hashed = HashedFeatures(names)
        return pd.Series([hashed.of(t).tolist() for t in texts])

    return features(text)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, steps: int = 300, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """Fit on at most ``max_rows`` labelled documents; labels without an id or value and documents without a text are left out.

    An id that is labelled more than once is toxic if one of its labels says so; of an id's texts the one with the
    smallest hash is taken. Other columns aren't read.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(toxic_col).cast("int")).alias("toxic"))
    ordered = lambda v: marks.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id")
    n_toxic, n_clean = marks.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    take = min(n_toxic, max(max_rows // 2, max_rows - n_clean))
    wanted = ordered(1).limit(take).unionByName(ordered(0).limit(max_rows - take))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    joined = source.join(F.broadcast(wanted), "doc_id")  # at most max_rows rows of two numbers
    one = joined.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = one.select("doc_id", feature_column(F.col("text")).alias("f"), "toxic").toArrow().sort_by("doc_id")  # as many rows
    if not got.num_rows:
        return fit_rows([], np.empty(0), steps)
    flat = got["f"].combine_chunks()
    return fit_rows(np.split(flat.values.to_numpy(), flat.offsets.to_numpy()[1:-1]), got["toxic"].to_numpy(), steps, toxic_share=n_toxic / (n_toxic + n_clean))


def score_column(text: Column, model: Model) -> Column:
    """A struct of the expected severity and P(grade >= 1)."""

    @F.pandas_udf("severity double, p_toxic double")
    def score(texts: pd.Series) -> pd.DataFrame:
        hashed, weights = HashedFeatures(names, used=model.index), model.dense()
        p = model.survival(np.array([weights[hashed.of(t)].sum() for t in texts], float))
        p[[not t or t.isspace() for t in texts]] = 0.0
        return pd.DataFrame({"severity": p.sum(1), "p_toxic": p[:, 0] if len(p) else []})

    return score(text)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, expected_severity, p_toxic, grade, kept``.

    A null, empty or blank text is clean, with a severity of 0. Repeated rows get equal scores; other columns aren't
    read. Without labelled rows of both kinds every document gets the one kind seen, and clean if there is none.
    Texts of any length are scored whole, by their distinct words.
    """
    s = docs.select(F.col(id_col).alias("doc_id"), score_column(F.col(text_col), model).alias("s"))
    return s.select("doc_id", F.col("s.severity").alias("expected_severity"), F.col("s.p_toxic").alias("p_toxic"), F.round("s.severity").cast("int").alias("grade"), (F.col("s.p_toxic") < REJECT_AT).alias("kept"))


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns.

    Null, empty and blank texts stay, as do all rows of a text or none; whole texts of any length are scored. An empty table stays empty.
    """
    return docs.where(score_column(F.col(text_col), model)["p_toxic"] < REJECT_AT)
