"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each whole text. The votes of all documents are counted by
pattern (at most 3 to the number of labellers, whatever the corpus size), and expectation-maximisation on those counts
estimates the share of good documents and each labeller's vote probabilities given the truth. A document's posterior
trains a linear scorer on hashed features, on at most ``max_rows`` distinct texts, those with the smallest hash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .features import DIMENSIONS, TOKEN, HashedFeatures, Rows, sigmoid

MAX_ROWS = 12_000
KEEP_AT = 0.5
LABELLERS = ("symbols", "capitals", "adjacent_repeats", "few_distinct", "bars", "word_length", "sentence_ends")
_SYMBOLS = "%$&*#|!^~=<>{}\\_@+"
_ENDS = re.compile(r"[.,;:?!](?=[\x20\x09-\x0D]|\Z)")


class _Shapes(dict):
    """Code point to the sign of its kind: capital, digit, other letter; other signs stand for themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        value = self[code] = "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c
        return value


_SHAPES = _Shapes()


def _statistics(words: list[str]) -> tuple[float, float, float]:
    """Shares of words that repeat the one before, distinct words in windows of 100, and bars."""
    n = max(1, len(words))
    windows = [words[i : i + 100] for i in range(0, len(words), 100) if len(words) - i >= 50 or i == 0]
    distinct = sum(len(set(w)) / len(w) for w in windows) / len(windows) if windows else 1.0
    return sum(map(eq, words, words[1:])) / n, distinct, words.count("|") / n


class Profile:
    """What labellers and features share of a whole text."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = TOKEN.findall(self.text)
        self.shapes = self.text.translate(_SHAPES)
        self.repeats, self.distinct, self.bars = _statistics(self.words)


def votes(of: Profile) -> str:
    """A digit per labeller: 0 abstains, 1 bad, 2 good. Texts of fewer than 5 words get no vote."""
    n = len(of.words)
    if n < 5:
        return "0" * len(LABELLERS)
    chars = sum(map(len, of.words))
    symbols = sum(map(of.text.count, _SYMBOLS)) / chars
    capitals = of.shapes.count("A")
    upper = capitals / max(1, capitals + of.shapes.count("a"))
    repeats, distinct, bars = of.repeats, of.distinct, of.bars
    length, ends = chars / n, len(_ENDS.findall(of.text)) / n

    def vote(value: float, bad: bool, good: bool) -> str:
        return "1" if bad else "2" if good else "0"

    return "".join(
        (
            vote(symbols, symbols > 0.10, symbols < 0.02),
            vote(upper, upper > 0.5, upper < 0.2),
            vote(repeats, repeats > 0.10, repeats < 0.03),
            vote(distinct, n >= 30 and distinct < 0.45, n >= 30 and distinct > 0.55),
            vote(bars, bars > 0.10, bars == 0),
            vote(length, length > 12 or length < 2, 3 <= length <= 9),
            vote(ends, ends > 0.5 or n >= 40 and ends == 0, 0.01 <= ends <= 0.35),
        )
    )


@dataclass
class Labelling:
    """Share of good documents, and P(vote | truth): labeller, truth (0 bad, 1 good), vote (0 abstains, 1 bad, 2 good)."""

    prior: float
    table: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        v = np.array([[int(c) for c in p] for p in patterns], int).reshape(len(patterns), len(self.table))
        log = np.log(self.table)
        score = [np.log(p) + sum(log[j, t, v[:, j]] for j in range(len(log))) for t, p in ((0, 1 - self.prior), (1, self.prior))]
        return sigmoid(score[1] - score[0])

    def accuracy(self) -> np.ndarray:
        """P(vote is right | the labeller votes), by labeller."""
        right = (1 - self.prior) * self.table[:, 0, 1] + self.prior * self.table[:, 1, 2]
        voted = (1 - self.prior) * self.table[:, 0, 1:].sum(1) + self.prior * self.table[:, 1, 1:].sum(1)
        return right / voted


def expectation_maximisation(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> Labelling:
    """From counted vote patterns.

    It starts from labellers whose bad votes are rare on good texts and miss most bad ones, as each knows one kind of
    fault; this fixes which class is the good one.
    """
    m = len(LABELLERS)
    start = np.tile(np.array([[0.2, 0.4, 0.4], [0.2, 0.03, 0.77]]), (m, 1, 1))
    now = Labelling(0.8, start)
    if not len(patterns):
        return now
    v = np.array([[int(c) for c in p] for p in patterns], int)
    c = np.asarray(counts, float)
    for _ in range(rounds):
        q = now.posterior(patterns) * c
        table = np.empty_like(start)
        for t, mass in ((0, c - q), (1, q)):
            for j in range(m):
                n = np.bincount(v[:, j], mass, 3) + 0.5
                table[j, t] = n / n.sum()
        prior = float(np.clip(q.sum() / c.sum(), 1e-3, 1 - 1e-3))
        done = abs(prior - now.prior) < 1e-9 and np.abs(table - now.table).max() < 1e-9
        now = Labelling(prior, table)
        if done:
            break
    return now


def names(shape: str) -> list[str]:
    """A word's shape whole, at its end and at its start, and its length."""
    return ["s" + shape[:12], "e" + shape[-3:], "b" + shape[:2], f"l{min(len(shape), 20)}"]


def features(of: Profile, hashed: HashedFeatures) -> np.ndarray:
    """Features of the words' shapes, and repetition, bars and words in capitals in steps."""
    upper = sum(map(str.isupper, of.words)) / max(1, len(of.words))
    return hashed.of(of.shapes, (f"repeat{int(20 * of.repeats)}", f"distinct{int(10 * of.distinct)}", f"bars{int(20 * of.bars)}", f"upper{int(10 * upper)}"))


def fit_linear(rows: list[np.ndarray], target: np.ndarray, steps: int = 150, l2: float = 1e-4, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad; rows are scaled to unit length."""
    x, w, bias = Rows(rows), np.zeros(DIMENSIONS), 0.0
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(x.row, minlength=x.n)))
    sum_w, sum_b = np.full(DIMENSIONS, 1e-8), 1e-8
    for _ in range(steps if x.n else 0):
        error = (sigmoid(x.dot(w) * scale + bias) - target) / x.n
        g = x.back(error * scale, DIMENSIONS) + l2 * w
        sum_w += g * g
        w -= rate * g / np.sqrt(sum_w)
        sum_b += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(sum_b)
    return w, bias


def vote_column(text: str) -> Column:
    @F.pandas_udf("string")
    def cast(texts: pd.Series) -> pd.Series:
        return pd.Series([votes(Profile(t)) for t in texts], dtype="object")

    return cast(text)


def training_column(text: str) -> Column:
    """A struct of votes and feature indices."""

    @F.pandas_udf("votes string, f array<int>")
    def extract(texts: pd.Series) -> pd.DataFrame:
        hashed, of = HashedFeatures(names), [Profile(t) for t in texts]
        return pd.DataFrame({"votes": [votes(p) for p in of], "f": [features(p, hashed) for p in of]})

    return extract(text)


def scorer(text: Column, weights: np.ndarray, bias: float) -> Column:
    """A struct of votes and score."""
    used = np.flatnonzero(weights)
    values = weights[used]

    @F.pandas_udf("votes string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        w, hashed = np.zeros(DIMENSIONS), HashedFeatures(names)
        w[used] = values
        cast, sums = [], []
        for t in texts:
            of = Profile(t)
            f = features(of, hashed)
            cast.append(votes(of))
            sums.append(w[f].sum() / np.sqrt(max(1, len(f))) + bias)
        return pd.DataFrame({"votes": cast, "score": sigmoid(np.array(sums, float))})

    return score(text)


def quality(docs: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, votes, posterior, score, kept``.

    ``posterior`` is the label model's probability that the text is good, ``score`` the trained scorer's; ``kept`` is
    a score of at least 0.5. Null, empty and very short texts get no votes and the posterior of a text without votes.
    Repeated rows get equal values, and a text that repeats trains once. An empty table gives an empty result. Texts of
    any length are read whole. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = materialise(rows.groupBy(vote_column("text").alias("votes")).agg(F.count("*").alias("n"))).toPandas()  # at most 3 ** len(LABELLERS) rows
    model = expectation_maximisation(counted["votes"].tolist(), counted["n"].to_numpy())
    known = dict(zip(counted["votes"], model.posterior(counted["votes"].tolist()).tolist(), strict=True))
    hashed = rows.where("text is not null").select(F.xxhash64("text").alias("h"), "text")
    sample = hashed.select("h").distinct().orderBy("h").limit(max_rows)
    texts = hashed.join(F.broadcast(sample), "h").groupBy("h").agg(F.min("text").alias("text"))  # max_rows rows of one long each
    train = texts.select("h", training_column("text").alias("t")).select("h", "t.votes", "t.f").toArrow().sort_by("h")
    flat = train["f"].combine_chunks()
    f = np.split(flat.values.to_numpy(), flat.offsets.to_numpy()[1:-1]) if len(flat) else []
    weights, bias = fit_linear(f, np.array([known[v] for v in train["votes"].to_pylist()]))
    posteriors = docs.sparkSession.createDataFrame(pd.DataFrame({"votes": list(known), "posterior": list(known.values())}), "votes string, posterior double")
    out = rows.select("doc_id", scorer(F.col("text"), weights, bias).alias("s")).select("doc_id", "s.votes", "s.score").join(F.broadcast(posteriors), "votes", "left")
    return out.select("doc_id", "votes", "posterior", "score", (F.col("score") >= KEEP_AT).alias("kept"))
