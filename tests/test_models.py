"""Known answers of the fitted models."""

import numpy as np
import pytest

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fieldlift.operators import boosting, models


@pytest.fixture(scope="module")
def accounts(spark):
    rng = np.random.default_rng(4)
    n = 1500
    x, g, t = rng.normal(size=n), rng.choice(["A", "B"], n), rng.normal(size=n)
    d = 0.7 * x + t
    y = 0.5 * d + np.where(g == "A", 1.0, 0.0) + 0.8 * x + 0.3 * rng.normal(size=n)
    treated = (rng.random(n) < 0.5).astype(float)
    gain = 2.0 * treated * (g == "A") + 0.3 * rng.normal(size=n)
    fills = np.exp(2 + x + (g == "A") + 0.5 * rng.normal(size=n))
    fills[:20] = 0
    rows = [(i, str(g[i]), None if i % 50 == 0 else "R", float(np.exp(x[i]) * 10), 5.0, 1.0, float(x[i]), float(d[i]), float(y[i]), float(treated[i]), float(gain[i]), float(fills[i])) for i in range(n)]
    names = "npi long, specialty_group string, region string, panel_benes double, non_class_clms double, risk_score double, x0 double, d double, y double, treated double, gain double, class_fills double"
    return models.materialise(spark.createDataFrame(rows, names).na.fill({"region": "Unknown"}))


def test_frontier_covers_its_quantile(accounts):
    m = models.fit_frontier(accounts, tau=0.8)
    c = models.coverage(accounts, m).first()
    assert c["n"] == 1480 and not c["off"] and abs(c["coverage"] - 0.8) < 0.02
    p = models.permutation_importance(accounts, m, repeats=2)
    got = {r["feature"]: r["share"] for r in p.collect()}
    assert got["log_panel_benes"] > got["specialty_group"] > got["risk_score"] and sum(got.values()) == pytest.approx(1)
    assert m.predict(accounts).where("frontier is null or frontier < 0").count() == 0
    with pytest.raises(ValueError, match="no rows"):
        models.fit_frontier(accounts.where("class_fills > 0").withColumn("class_fills", accounts.class_fills * 0), trees=1)


def test_importance_exchanges_features_in_a_task(accounts):
    """A row isn't repeated by feature; scores are those of rows with the donor's feature."""
    m = models.fit_frontier(accounts, trees=20)
    assert "explode" not in models.permutation_importance(accounts, m)._jdf.queryExecution().toString()
    trees, rng = m.model.trees, np.random.default_rng(1)
    bins, others = (rng.integers(0, 128, (50, len(m.model.binning.edges)), np.uint8) for _ in range(2))
    for k, got in enumerate(trees.exchanged(bins, others)):
        swapped = bins.copy()
        swapped[:, k] = others[:, k]
        assert got == pytest.approx(trees.score(swapped))


def test_double_ml_and_robustness(accounts):
    r = models.double_ml(accounts, "y", "d", ["x0"]).first()
    assert abs(r["theta"] - 0.5) < 2 * r["se"] + 0.02 and r["ci_low"] < r["theta"] < r["ci_high"] and 0 < r["rv_alpha"] < r["rv"] < 1


def test_uplift_orders_effects(accounts):
    e = models.materialise(models.uplift(accounts, "gain", "treated", ["x0"]))
    by = {r["specialty_group"]: r["avg(tau)"] for r in e.join(accounts, "npi").groupBy("specialty_group").avg("tau").collect()}
    assert abs(by["A"] - 2) < 0.4 and abs(by["B"]) < 0.4
    q = {round(r["fraction_targeted"], 3): r for r in models.qini(e).collect()}
    assert len(q) == 41 and q[0.0]["uplift_model"] == 0 and q[1.0]["uplift_model"] == pytest.approx(q[1.0]["uplift_random"])
    assert q[0.5]["uplift_model"] > q[0.5]["uplift_random"]
    assert models.qini(e.limit(0)).count() == 41
    assert {r["n"] for r in models.uplift_deciles(e).collect()} == {150}


def test_registered_settings():
    """Registered queries pass no settings of their own: what they run with are the operators' defaults."""
    import inspect

    from fieldlift.plans import registry
    from fieldlift.plans import advanced, modelled  # isort: skip

    assert {"d15_tau_sensitivity", "ev8_forecast"} <= set(registry.QUERIES)
    for module in (modelled, advanced):
        source = inspect.getsource(module)
        assert not [w for w in ("trees=", "iterations=", "rate=", "depth=", "reps=") if w in source]


def test_contributions_add_up(accounts):
    from fieldlift.operators import explain

    m = models.fit_frontier(accounts, trees=6)
    e = models.materialise(explain.attribution(accounts, m))
    total = e.selectExpr("npi", "prediction", "base + aggregate(contributions, 0D, (a, c) -> a + c.contribution) as total").join(m.log_potential(models.feature_frame(accounts)[0].select("npi", *m.features, *models.CATEGORICAL)), "npi")
    assert total.where("abs(total - prediction) > 1e-9 or abs(prediction - __f) > 1e-9").count() == 0
    top = {r["feature"] for r in explain.top_drivers(e, 1).collect()}
    assert "log_panel_benes" in top
    assert sum(r["share"] for r in explain.global_drivers(e).collect()) == pytest.approx(1)


# Boosting


def plain_boost(x, y, loss, tau, trees, depth, rate, least, l2):
    """Level-wise boosting on raw values, one row and threshold after another."""
    n = len(y)
    f = np.full(n, np.quantile(y, tau, method="inverted_cdf") if loss == "quantile" else y.mean())
    for _ in range(trees):
        g = tau - (y < f) if loss == "quantile" else y - f
        groups = [np.arange(n)]
        leaves = []
        for _ in range(depth):
            after = []
            for rows in groups:
                score = lambda r: g[r].sum() ** 2 / (len(r) + l2)  # noqa: B023, E731
                best = None
                for k in range(x.shape[1]):
                    for v in np.unique(x[rows, k])[:-1]:
                        a, b = rows[x[rows, k] <= v], rows[x[rows, k] > v]
                        if len(a) >= least and len(b) >= least:
                            gain = score(a) + score(b) - score(rows)
                            if best is None or gain > best[0] + 1e-12:
                                best = (gain, a, b)
                if best and best[0] > 1e-12:
                    after += best[1:]
                else:
                    leaves.append(rows)
            groups = after
        for rows in leaves + groups:
            r = y[rows] - f[rows]
            f[rows] = f[rows] + rate * (np.quantile(r, tau, method="inverted_cdf") if loss == "quantile" else r.sum() / (len(r) + l2))
    return f


@pytest.mark.parametrize(("loss", "tau"), [("squared", 0.5), ("quantile", 0.8)])
def test_boosting_equals_a_plain_one(spark, loss, tau):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(160, 3)), 1)
    y = x[:, 0] * 2 + (x[:, 1] > 0) + 0.1 * rng.normal(size=160)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(160)], "npi long, x array<double>, y double").repartition(3)
    options = {"trees": 4, "depth": 2, "rate": 0.5, "least": 15, "l2": 0.0 if loss == "quantile" else 1.0}
    m = boosting.fit(df, {"p": boosting.Target("y", loss, tau)}, **options)["p"]
    got = {r["npi"]: r["p"] for r in m.predict(df, "p").collect()}
    want = plain_boost(x, y, loss, tau, **options)
    assert [got[i] for i in range(160)] == pytest.approx(want.tolist(), abs=2e-5)


def test_tasks_that_share_rows_grow_the_same_trees(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=900), rng.integers(0, 5, 900)
    y = np.sin(2 * x) + (c == 2) + 0.2 * rng.normal(size=900)
    df = models.materialise(spark.createDataFrame([(i, [float(x[i]), float(c[i])], float(y[i]), float(y[i] > 0.4), i % 3) for i in range(900)], "npi long, x array<double>, y double, b double, fold int").withColumn("v", array_to_vector("x")))
    targets = {"m": boosting.Target("y"), "p": boosting.Target("b", "logistic"), "q": boosting.Target("y", "quantile", 0.3), "r": boosting.Target(F.col("b") * 3, "poisson"), "h": boosting.Target("y", weight=(F.col("fold") != 1).cast("double"), features=(1,))}
    options = {"trees": 20, "depth": 3, "rate": 0.2, "least": 20, "categorical": [1]}
    alone, shared = boosting.fit(df, targets, **options), boosting.fit(df, targets, task_rows=1500, **options)
    a = {r["npi"]: r for r in boosting.predict(df, alone).collect()}
    b = {r["npi"]: r for r in boosting.predict(df, shared, "v").collect()}
    for n in targets:
        assert [a[i][n] for i in range(900)] == pytest.approx([b[i][n] for i in range(900)], abs=1e-9)
    assert abs(np.mean([a[i]["q"] >= y[i] for i in range(900)]) - 0.3) < 0.05
    assert np.corrcoef([a[i]["m"] for i in range(900)], y)[0, 1] > 0.9
    p = np.array([a[i]["p"] for i in range(900)])
    assert ((p > 0) & (p < 1)).all() and np.mean((p > 0.5) == (y > 0.4)) > 0.85
    assert np.mean([a[i]["r"] for i in range(900)]) == pytest.approx(3 * np.mean(y > 0.4), rel=0.05)
    assert len({round(a[i]["h"], 9) for i in range(900)}) == 5
    assert max((t.trees.feature >= 0).sum(1).max() for t in alone.values()) <= 7


def test_boosting_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0], 2.0), (2, [2.0], None)], "npi long, x array<double>, y double")
    options = {"trees": 2, "depth": 2, "rate": 0.5, "least": 1}
    assert boosting.fit(df, {"a": boosting.Target("y")}, **options) == {"a": None}
    made = boosting.fit(df, {"a": boosting.Target("y"), "b": boosting.Target("npi")}, **options)
    assert made["a"] is None and [r["b"] for r in made["b"].predict(df, "b").orderBy("npi").collect()] == [1.125, 1.875]
    assert boosting.fit(df.limit(0), {"a": boosting.Target("y")}, **options) == {"a": None}


def test_a_task_takes_what_its_memory_holds(spark, monkeypatch):
    """An exchange of a barrier stage takes a second: 300 trees of 260,000 rows took 40 minutes."""
    asked, trainer = [], boosting._trainer
    monkeypatch.setattr(boosting, "_trainer", lambda b, t, o, barrier: asked.append(barrier) or trainer(b, t, o, barrier))
    df = spark.range(260_000).select("id", F.array((F.col("id") % 90).cast("double")).alias("x"), F.floor(F.col("id") % 90 / 10).cast("double").alias("y"))
    made = boosting.fit(df, {"y": boosting.Target("y")}, trees=2, depth=6, rate=1.0, least=10)["y"]
    assert asked == [False]
    assert made.predict(df, "p").where("abs(p - y) > 1").count() == 0


def test_sums_of_the_larger_child_are_what_is_left():
    rng = np.random.default_rng(6)
    bins, y, w = rng.integers(0, 9, (500, 3)).astype(np.uint8, order="F"), rng.normal(size=500), rng.random(500)
    options = {"trees": 1, "depth": 3, "least": 5, "l2": 0.0, "leaves": 31, "categorical": [False, True, False]}
    g = boosting._Growing(("squared", 0.5, None), bins, y, w, options)
    g.begin(0.0)
    g.slope()
    g.leaves = 1
    for _ in range(2):
        g.split(0, g.sums())
    assert len(g.active) == 4 and len(g.asked) == 2 and sum(len(r) for r in g.rows.values()) == 500
    got = g._of_active(g.sums())
    g.asked, g.parents = g.active, None
    assert np.abs(got - g.sums()).max() < 1e-9
