"""Histogram gradient boosting of several models at once.

Features are binned once by quantiles that Spark computes. Rows are dealt to tasks with the number of the model that they
train; a task keeps its rows as bins in numpy and grows all trees level by level. With few rows there is a task for each model.
Beyond ``TASK_ROWS`` the stage is a barrier stage: each task has a share of all models' rows, and a level's sums by (model,
node, feature, bin) are exchanged among the tasks, so that all of them choose the same splits; each exchange waits for a second,
some seven a tree, so only what is too large for a task goes that way. Either way it is one Spark job, whatever the number of trees, folds and targets. A barrier stage whose executor is lost runs again as a whole.
Messages have a fixed size by level; a task's memory is its share of the rows. Barrier stages need static allocation.

What reaches the driver is the trees.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import materialise

BINS = 128
#: Rows of a model that one task trains on, some 100 bytes each. An exchange of a barrier stage takes a second, whatever its size.
TASK_ROWS = 4_000_000
#: Bins of a pass over residuals; a leaf's quantile is found in two passes, within a millionth of its range.
SKETCH = 1024
#: Leaves of a tree; they go to the splits of highest gain of a level first.
LEAVES = 31

Exchange = Callable[[object], list]


@dataclass(frozen=True)
class Target:
    """What a model predicts: a column, its loss (``squared``, ``logistic``, ``poisson`` or ``quantile``), the weights of rows (0: left out) and the features it may use."""

    label: Column | str
    loss: str = "squared"
    tau: float = 0.5
    weight: Column | None = None
    features: tuple[int, ...] | None = None


@dataclass
class Binning:
    """Upper edges of the bins of each numeric feature; None for a category, whose codes are its bins (the last bin takes the rest)."""

    edges: list[np.ndarray | None]

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8, order="F")
        for k, e in enumerate(self.edges):
            out[:, k] = np.clip(x[:, k], 0, BINS - 1) if e is None else np.searchsorted(e, x[:, k])
        return out


@dataclass
class Trees:
    """Complete binary trees by array position (children of i: 2i + 1 and 2i + 2): split feature (-1: leaf), bins that go left, value and training rows."""

    start: float
    rate: float
    depth: int
    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray
    count: np.ndarray

    def values(self, bins: np.ndarray, which: Sequence[int] | None = None) -> Iterator[np.ndarray]:
        """The rows' leaf values, tree by tree, of all trees or of some."""
        flat, first = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
        inner, every = self.feature >= 0, np.arange(self.feature.shape[1])
        seen, after = np.maximum(self.feature, 0), np.where(inner, 2 * every + 2, every)  # a leaf leads to itself
        for t in range(len(self.feature)) if which is None else which:
            node, left = np.zeros(len(bins), np.int64), self.left[t].ravel()
            for _ in range(self.depth):
                node = after[t].take(node) - left.take(node * BINS + flat.take(first + seen[t].take(node)))
            yield self.value[t].take(node)

    def score(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for value in self.values(bins):
            out += self.rate * value
        return out

    def exchanged(self, bins: np.ndarray, others: np.ndarray) -> Iterator[np.ndarray]:
        """Scores with one feature after the other taken from ``others``; only trees that split on the feature are asked again."""
        own = np.stack(list(self.values(bins))) if len(self.feature) else np.zeros((0, len(bins)))
        for k in range(bins.shape[1]):
            using = np.flatnonzero((self.feature == k).any(1))
            changed = bins.copy()
            changed[:, k] = others[:, k]
            rest = np.delete(own, using, 0).sum(0)
            yield self.start + self.rate * sum(self.values(changed, using), rest)


@dataclass
class Boosted:
    """A fitted model."""

    binning: Binning
    trees: Trees
    loss: str
    tau: float

    def predict(self, df: DataFrame, name: str = "__f", x: str = "x") -> DataFrame:
        return predict(df, {name: self}, x)


def predict(df: DataFrame, models: Mapping[str, Boosted], x: str = "x", folds: Mapping[str, int] | None = None) -> DataFrame:
    """``df`` with a column for each model, in one pass: a probability or a mean for the logistic and Poisson losses, else the value.

    With ``folds``, rows get the values of the models of their own ``fold``, and NaN from the others.
    """
    binning = next(iter(models.values())).binning
    names = list(models)
    trees = [m.trees for m in models.values()]
    losses = [m.loss for m in models.values()]

    # The other columns go through the pass as they are.
    kept = [c for c in df.columns if c not in names]
    rows = df.select(*kept, _array(df, x).alias("__x")) if kept else df

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = binning.of(matrix(b.column("__x"), len(binning.edges)))
            found = []
            for n, t, loss in zip(names, trees, losses, strict=True):
                own = slice(None) if folds is None else np.flatnonzero(b.column("fold").to_numpy() == folds[n])
                found.append(np.full(len(bins), np.nan))
                found[-1][own] = LINK.get(loss, lambda f: f)(t.score(bins[own]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, found)], names=[*kept, *names])

    schema = df.select(*kept).schema
    for n in names:
        schema = schema.add(n, "double")
    return rows.mapInArrow(rows_of, schema)


def _array(df: DataFrame, x: str) -> Column:
    return F.col(x) if df.schema[x].dataType.typeName() == "array" else vector_to_array(x)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def _exp(f: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(f, -40, 40))


LINK = {"logistic": _sigmoid, "poisson": _exp}


def binned(rows: DataFrame, x: str = "x", categorical: Sequence[int] = ()) -> Binning:
    """Bins of equal numbers of rows for each numeric feature, approximate within 1e-4 of a rank, from one aggregation."""
    rows = rows.select(_array(rows, x).alias("x"))
    width = rows.select(F.max(F.size("x"))).first()[0] or 0
    numeric = [k for k in range(width) if k not in set(categorical)]
    share = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(k)), share, 10_000).alias(f"e{k}") for k in numeric]).first() if numeric else []
    edges: list[np.ndarray | None] = [None] * width
    for k, e in zip(numeric, found, strict=True):
        edges[k] = np.unique(np.array(e or [], float))
    return Binning(edges)


# Inside tasks


class _Growing:
    """The rows of one model in a task, by the node that they have reached, and its trees so far.

    Of two children the sums are taken over the rows of the smaller one; the other's are what is left of their parent's.
    """

    def __init__(self, target: tuple[str, float, tuple[int, ...] | None], bins: np.ndarray, y: np.ndarray, w: np.ndarray, options: dict):
        self.loss, self.tau, allowed = target
        self.bins, self.y, self.w, self.o = bins, y, w, options
        self.features = list(range(bins.shape[1])) if allowed is None else list(allowed)
        nodes = 2 ** (options["depth"] + 1) - 1
        shape = (options["trees"], nodes)
        self.feature, self.value, self.count = np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape)
        self.left = np.zeros((*shape, BINS), bool)
        self.f = np.zeros(len(y))
        self.plain = self.loss in ("squared", "quantile") and bool((w == 1).all())  # the curvature is the number of rows
        self.every = np.arange(len(y))
        self.rows = {0: self.every}

    def begin(self, start: float) -> None:
        self.start = start
        self.f[:] = start

    def slope(self) -> None:
        if self.loss == "squared":
            g, h = self.y - self.f, np.ones(len(self.y))
        elif self.loss == "logistic":
            p = _sigmoid(self.f)
            g, h = self.y - p, p * (1 - p)
        elif self.loss == "poisson":
            h = _exp(self.f)
            g = self.y - h
        else:
            g, h = self.tau - (self.y < self.f), np.ones(len(self.y))
        self.g, self.h = (g, h) if self.plain else (g * self.w, h * self.w)
        self.rows = {0: self.every}
        self.active, self.asked, self.parents = [0], [0], None

    def sums(self) -> np.ndarray:
        """Gradient, curvature and rows by asked node, feature and bin."""
        out = np.zeros((3, len(self.asked), len(self.features), BINS))
        for i, node in enumerate(self.asked):
            at = self.rows[node]
            whole = len(at) == len(self.y)
            g, h = (self.g, self.h) if whole else (self.g[at], None if self.plain else self.h[at])
            for j, f in enumerate(self.features):
                key = self.bins[:, f] if whole else self.bins[:, f][at]
                out[0, i, j], out[2, i, j] = np.bincount(key, g, BINS), np.bincount(key, minlength=BINS)
                out[1, i, j] = out[2, i, j] if self.plain else np.bincount(key, h, BINS)
        return out

    def _of_active(self, sums: np.ndarray) -> np.ndarray:
        """Sums of all active nodes, in their order, from those of the asked ones and of the parents."""
        if self.parents is None:
            return sums
        rest = self.parents - sums
        rest[:2] *= rest[2] > 0
        first = (np.array(self.asked) == self.active[::2])[:, None, None]
        return np.stack([np.where(first, sums, rest), np.where(first, rest, sums)], 2).reshape(3, -1, *sums.shape[2:])

    def split(self, t: int, sums: np.ndarray) -> None:
        """Split active nodes where the gain is positive, as long as there are leaves left; their rows go on to the children."""
        every = self._of_active(sums)
        g, h, n = every
        category = np.array([self.o["categorical"][f] for f in self.features], bool)
        order = np.broadcast_to(np.arange(BINS), g.shape).copy()
        if category.any():  # categories in the order of their means
            mean = np.where(n > 0, g / np.maximum(h, 1e-12), np.inf)
            order[:, category] = np.argsort(mean[:, category], axis=2, kind="stable")
        g, h, n = (np.cumsum(np.take_along_axis(a, order, 2), 2) for a in (g, h, n))
        G, H, N = g[:, :1, -1:], h[:, :1, -1:], n[:, :1, -1:]
        score = lambda a, b: np.square(a) / np.maximum(b + self.o["l2"], 1e-12)
        gain = score(g, h) + score(G - g, H - h) - score(G, H)
        gain[(n < self.o["least"]) | (N - n < self.o["least"])] = -np.inf
        k = len(self.active)
        flat = gain.reshape(k, -1)
        best = flat.argmax(1)
        top = flat[np.arange(k), best]
        self.count[t, self.active] = N[:, 0, 0]
        self.value[t, self.active] = G[:, 0, 0] / np.maximum(H[:, 0, 0] + self.o["l2"], 1e-12)
        room = self.o["leaves"] - self.leaves
        chosen = sorted([i for i in np.argsort(-top, kind="stable") if top[i] > 1e-12][:room])
        self.leaves += len(chosen)
        after, asked = [], []
        for i in chosen:
            node, (j, b) = self.active[i], divmod(int(best[i]), BINS)
            f = self.features[j]
            self.feature[t, node] = f
            self.left[t, node, order[i, j, : b + 1]] = True
            at = self.rows.pop(node)
            go = self.left[t, node][self.bins[:, f][at]]
            children = [2 * node + 1, 2 * node + 2]
            self.rows |= dict(zip(children, (at[go], at[~go]), strict=True))
            after += children
            asked.append(children[int(2 * n[i, j, b] > N[i, 0, 0])])
        self.active, self.asked, self.parents = after, asked, every[:, chosen]

    def leaf_sums(self) -> np.ndarray:
        out = np.zeros((3, self.feature.shape[1]))
        for node, at in self.rows.items():
            out[:, node] = self.g[at].sum(), len(at) if self.plain else self.h[at].sum(), len(at)
        return out


def _added(parts: list) -> object:
    return {m: sum(p[m] for p in parts) for m in parts[0]}


def _quantiles(models: Mapping[int, _Growing], counts: Mapping[int, np.ndarray], exchange: Exchange) -> dict[int, np.ndarray]:
    """Quantile of the residuals by model and node, from counts in ``SKETCH`` bins over the range and again inside the bin that is hit."""
    residual, edges = {}, {}
    for m, g in models.items():
        rest = g.y - g.f
        residual[m] = {node: rest[at] for node, at in g.rows.items() if len(at)}
        low, high = np.full(counts[m].shape, np.inf), np.full(counts[m].shape, -np.inf)
        for node, r in residual[m].items():
            low[node], high[node] = r.min(), r.max()
        edges[m] = (low, high)
    parts = exchange(edges)
    low = {m: np.where(counts[m] > 0, np.min([p[m][0] for p in parts], 0), 0.0) for m in models}
    high = {m: np.where(counts[m] > 0, np.max([p[m][1] for p in parts], 0), 0.0) for m in models}
    before = {m: np.zeros(c.shape) for m, c in counts.items()}
    for _ in range(2):
        found = {}
        for m in models:
            width = np.where(high[m] > low[m], high[m] - low[m], 1.0)
            found[m] = np.zeros((len(counts[m]), SKETCH), np.int64)
            for node, r in residual[m].items():
                r = r[(r >= low[m][node]) & (r <= high[m][node])]
                at = np.minimum((r - low[m][node]) / width[node] * SKETCH, SKETCH - 1).astype(np.int64)
                found[m][node] = np.bincount(at, minlength=SKETCH)
        total = _added(exchange(found))
        for m in models:
            want = np.maximum(np.ceil(models[m].tau * counts[m]), 1)
            upto = before[m][:, None] + np.cumsum(total[m], 1)
            hit = np.minimum((upto < want[:, None]).sum(1), SKETCH - 1)
            before[m] = upto[np.arange(len(hit)), hit] - total[m][np.arange(len(hit)), hit]
            step = (high[m] - low[m]) / SKETCH
            low[m], high[m] = low[m] + hit * step, low[m] + (hit + 1) * step
    return {m: np.where(counts[m] > 0, (low[m] + high[m]) / 2, 0.0) for m in models}


def grow(models: Mapping[int, _Growing], options: dict, exchange: Exchange) -> dict[int, Trees]:
    """Grow all trees of the models, all of them a level at a time."""
    quantile = {m: g for m, g in models.items() if g.loss == "quantile"}
    start = _added(exchange({m: np.array([(g.w * g.y).sum(), g.w.sum(), len(g.y)]) for m, g in models.items()}))
    first = _quantiles(quantile, {m: start[m][2:] for m in quantile}, exchange) if quantile else {}
    for m, g in models.items():
        mean = start[m][0] / max(start[m][1], 1e-12)
        edge = min(max(mean, 1e-6), 1 - 1e-6)
        g.begin(float(first[m][0]) if m in first else np.log(edge / (1 - edge)) if g.loss == "logistic" else np.log(max(mean, 1e-6)) if g.loss == "poisson" else mean)
    for t in range(options["trees"]):
        for g in models.values():
            g.slope()
            g.leaves = 1
        for _ in range(options["depth"]):
            open_ = {m: g for m, g in models.items() if g.active}
            if not open_:
                break
            total = _added(exchange({m: g.sums() for m, g in open_.items()}))
            for m, g in open_.items():
                g.split(t, total[m])
        ends = _added(exchange({m: g.leaf_sums() for m, g in models.items()}))
        shift = _quantiles(quantile, {m: ends[m][2] for m in quantile}, exchange) if quantile else {}
        for m, g in models.items():
            there = ends[m][2] > 0
            g.count[t][there] = ends[m][2][there]
            newton = ends[m][0] / np.maximum(ends[m][1] + options["l2"], 1e-12)
            g.value[t][there] = (shift[m] if m in shift else newton)[there]
            for node, at in g.rows.items():
                g.f[at] += options["rate"] * g.value[t][node]
    return {m: Trees(float(g.start), options["rate"], options["depth"], g.feature, g.left, g.value, g.count) for m, g in models.items()}


def _gathered(context: BarrierTaskContext) -> Exchange:
    def exchange(part: object) -> list:
        return [pickle.loads(base64.b64decode(x)) for x in context.allGather(base64.b64encode(pickle.dumps(part)).decode())]

    return exchange


def _trainer(binning: Binning, targets: list[tuple[str, float, tuple[int, ...] | None]], options: dict, barrier: bool):
    width = len(binning.edges)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            held.append((b.column("model").to_numpy(), binning.of(matrix(b.column("x"), width)), b.column("y").to_numpy(), b.column("w").to_numpy()))
        model, bins, y, w = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.empty(0, int), np.empty((0, width), np.uint8), np.empty(0), np.empty(0))
        here = range(len(targets)) if barrier else np.unique(model).tolist()
        rows = {m: np.flatnonzero(model == m) for m in here}
        models = {m: _Growing(targets[m], np.asfortranarray(bins[r]), y[r], w[r], options) for m, r in rows.items()}
        context = BarrierTaskContext.get() if barrier else None
        done = grow(models, options, _gathered(context) if barrier else lambda part: [part]) if models else {}
        if not barrier or context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), pa.array([pickle.dumps(vars(t)) for t in done.values()], pa.binary())], names=["model", "trees"])

    return train


def fit(rows: DataFrame, targets: Mapping[str, Target], *, trees: int, depth: int, rate: float, least: int, l2: float = 0.0, leaves: int = LEAVES, x: str = "x", categorical: Sequence[int] = (), task_rows: int = TASK_ROWS) -> dict[str, Boosted | None]:
    """Models of the targets by name, all from one job; None for a target with fewer than two rows.

    ``x`` is a vector or an array without nulls, ``categorical`` the positions of codes in it. Rows without a label, or with a
    weight of 0, are left out of that model. Ties between splits go to the first feature and bin; results depend on how rows
    are dealt in the last digits of sums only.
    """
    names = list(targets)
    weight = lambda t: F.coalesce(t.weight.cast("double"), F.lit(0.0)) if t.weight is not None else F.lit(1.0)
    label = lambda t: (F.col(t.label) if isinstance(t.label, str) else t.label).cast("double")
    each = F.array(*[F.struct(F.lit(k).alias("model"), label(t).alias("y"), weight(t).alias("w")) for k, t in enumerate(targets.values())])
    flat = materialise(rows.select(_array(rows, x).alias("x"), each.alias("t")))
    binning = binned(flat, "x", categorical)
    long = flat.select("x", F.explode("t").alias("t")).select("t.model", "x", "t.y", "t.w").where("y is not null and not isnan(y) and w > 0")
    counts = {r["model"]: r["count"] for r in long.groupBy("model").count().collect()}  # a row per model
    fitted = [k for k in range(len(names)) if counts.get(k, 0) >= 2]
    if not fitted:
        return dict.fromkeys(names)
    long = long.where(F.col("model").isin(fitted))
    is_category = [e is None for e in binning.edges]
    options = {"trees": trees, "depth": depth, "rate": rate, "least": least, "l2": l2, "leaves": leaves, "categorical": is_category}
    specs = [(t.loss, t.tau, t.features) for t in targets.values()]
    barrier = max(counts.values()) > task_rows
    if barrier:
        slots = rows.sparkSession.sparkContext.defaultParallelism
        dealt = long.repartition(max(1, min(slots, -(-sum(counts.values()) // task_rows))), F.xxhash64("x", "y", "model"))
    else:
        dealt = long.repartitionById(len(names), F.col("model"))
    made = {r["model"]: Trees(**pickle.loads(r["trees"])) for r in dealt.mapInArrow(_trainer(binning, specs, options, barrier), "model int, trees binary", barrier=barrier).collect()}
    return {n: Boosted(binning, made[k], specs[k][0], specs[k][1]) if k in made else None for k, n in enumerate(names)}
