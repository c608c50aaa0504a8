"""Known answers and degenerate inputs of the account-targeting operators."""

import random

import pytest
from pyspark.sql import functions as F

from fieldlift.functions import exprs as X
from fieldlift.functions.session import materialise
from fieldlift.operators import backtest, market, opportunity, quality, ranks, sizing, stats, territory


def test_zip_and_distance(spark):
    df = spark.createDataFrame([("02134-5678",), ("2134",), ("902101",), (None,)], "z string")
    assert [r[0] for r in df.select(X.zip5(F.col("z"))).collect()] == ["02134", "02134", "90210", None]
    d = spark.range(1).select(X.miles(F.lit(40.7128), F.lit(-74.006), F.lit(34.0522), F.lit(-118.2437))).first()[0]
    assert 2400 < d < 2500


def test_global_scan_and_deciles(spark):
    rows = [(i, float(i // 7)) for i in range(1000)]
    df = spark.createDataFrame(rows, "npi long, v double").repartition(5)
    got = {r["npi"]: r for r in ranks.global_scan(df, [F.col("v"), F.col("npi")], {"run": F.col("v")}, total="n").collect()}
    total = 0.0
    for i, (npi, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        total += v
        assert (got[npi]["rn"], got[npi]["run"], got[npi]["n"]) == (i, total, 1000)
    assert {r["count"] for r in ranks.decile(df, "v", "d").groupBy("d").count().collect()} == {100}
    pct = {r["npi"]: r["p"] for r in ranks.percent_rank(df, "v", "p").collect()}
    assert pct[0] == pytest.approx(4 / 1000)
    assert ranks.global_scan(df.limit(0), [F.col("v")]).count() == 0


def test_suppression_bounds(spark):
    provider = spark.createDataFrame([(1, 2020, 30.0, "A"), (2, 2020, 12.0, "A"), (3, 2020, 5.0, "B")], "npi long, year int, all_drug_clms double, specialty_group string")
    rows = spark.createDataFrame([(1, 2020, "X", 12.0, 12.0, 1.0), (2, 2020, "Y", 12.0, 12.0, 1.0)], "npi long, year int, product string, tot_clms double, tot_fills double, tot_cost double")
    s = market.flag_products(rows, ["X"], ["X"])
    supp = market.reconcile_suppression(provider, s, market.all_totals(s), 11, 3)
    got = {r["npi"]: r for r in supp.collect()}
    assert (got[1]["suppressed_clms"], got[1]["suppressed_rows_min"], got[1]["hidden_class_clms_cap"]) == (18.0, 2.0, 20.0)
    assert got[2]["has_suppression"] is False and got[3]["suppressed_rows_ev"] == pytest.approx(5 / 5.5)
    for r in market.impute_class_volume(supp, market.class_volume(s)).collect():
        assert r["class_fills_zero"] <= r["class_fills_ev"] <= r["class_fills_max"]


def test_beta_prior_and_shrinkage(spark):
    random.seed(3)
    rows = []
    for i in range(6000):
        p, n = random.betavariate(6, 4), random.randint(30, 300)
        rows.append((i, "g", float(sum(random.random() < p for _ in range(n))), float(n)))
    prior = stats.beta_prior(spark.createDataFrame(rows, "npi long, g string, h double, n double"), "g", "h", "n")
    r = prior.first()
    assert abs(r["mean"] - 0.6) < 0.01 and 7 < r["strength"] < 13
    flat = spark.createDataFrame([("g", 5.0, 5.0)], "g string, a double, b double")
    s = stats.shrink(spark.createDataFrame([(1, "g", 2.0, 2.0), (2, "g", 200.0, 200.0)], "npi long, g string, h double, n double"), flat, "g", "h", "n")
    got = {r["npi"]: r["eb_share"] for r in s.collect()}
    assert got[1] < 0.65 and got[2] > 0.95


def test_drift_and_reliability(spark):
    random.seed(1)
    a = spark.createDataFrame([(random.gauss(0, 1),) for _ in range(4000)], "v double")
    b = spark.createDataFrame([(random.gauss(0, 1),) for _ in range(4000)], "v double")
    c = spark.createDataFrame([(random.gauss(1, 1),) for _ in range(4000)], "v double")
    assert stats.psi_numeric(a, b, "v").first()[0] < 0.02 and stats.psi_numeric(a, c, "v").first()[0] > 0.25
    assert stats.ks(a, a, "v").first()[0] == 0 and stats.ks(a, c, "v").first()[0] > 0.3
    groups = [(g, random.gauss(0, 2) if k == 0 else None) for g in range(200) for k in range(1)]
    rows = [(g, m + random.gauss(0, 0.5)) for g, m in groups for _ in range(10)]
    assert stats.icc(spark.createDataFrame(rows, "g int, v double"), "g", "v").first()["icc"] > 0.7
    noise = [(i % 200, random.gauss(0, 1)) for i in range(2000)]
    assert abs(stats.icc(spark.createDataFrame(noise, "g int, v double"), "g", "v").first()["icc"]) < 0.1


def test_leave_one_out(spark):
    links = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 8)], "npi long, practice long")
    values = spark.createDataFrame([(1, 0.0), (2, 0.3), (3, 0.6), (4, 1.0)], "npi long, v double")
    got = {r["npi"]: r["peer_mean"] for r in stats.leave_one_out(links, values, "v").collect()}
    assert got == pytest.approx({1: 0.45, 2: 0.3, 3: 0.15})


def test_contract(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (2, -1.0)], "k long, v double")
    c = quality.Contract(min_rows=2, key=["k"], columns=["k", "gone"], null_rate={"v": 0.1}, ranges={"v": (0, None)}, rules=["v > -5"])
    got = {r["check"]: r["passed"] for r in quality.check_contract(spark, "t", df, c).collect()}
    assert got == {"min rows": True, "unique key": False, "column k": True, "column gone": False, "null rate v": False, "range v": False, "rule v > -5": True}
    with pytest.raises(ValueError, match="missing table"):
        quality.enforce(quality.check_contract(spark, "t", None, c))


def test_sizing_has_diminishing_returns(spark):
    rows = [(i, float(100 - i % 90), 1.0 if i % 3 else 0.0) for i in range(300)]
    plan = spark.createDataFrame(rows, "npi long, opportunity double, desired_calls double")
    curve = sizing.roi_curve(sizing.evaluate(sizing.allocation(plan), sizing.grid(spark, {"base": sizing.base_case()}, [1, 2, 3, 4]))).orderBy("n_reps").collect()
    gains = [r["marginal_contribution"] for r in curve[1:]]
    assert gains == sorted(gains, reverse=True) and all(r["calls_allocated"] <= r["annual_call_capacity"] + 1e-9 for r in curve)


def test_territories_on_a_grid(spark):
    rows = [(f"{i}{j}", "S", 35 + 0.6 * i, -100 + 0.6 * j, float(5 + (7 * i + 3 * j) % 20)) for i in range(4) for j in range(4)]
    u = spark.createDataFrame(rows, "zip3 string, state string, lat double, lon double, workload double")
    e = territory.adjacency(u, 3, 1.0)
    assert e.where("a >= b").count() == 0 and e.count() >= 16
    near = territory.neighbourhoods(u, e)
    start = territory.kmeans(near, 3).withColumn("n_reps", F.lit(3))
    t = territory.repair_contiguity(territory.labelled(territory.capacity_assignment(near, territory.centroids(start))))
    assert t.count() == 16 and t.select("zip3").distinct().count() == 16
    assert territory.metrics(t, territory.components(t, e)).first()["contiguity_rate"] == 1.0


@pytest.fixture(scope="module")
def county(spark):
    rows = [(f"{i}{j}", f"S{j % 3}", 35 + 0.6 * i, -100 + 0.6 * j, float(5 + (7 * i + 3 * j) % 20)) for i in range(6) for j in range(6)]
    u = materialise(spark.createDataFrame(rows, "zip3 string, state string, lat double, lon double, workload double"))
    return u, materialise(territory.adjacency(u, 4, 1.0))


def plain_pieces(owner, links):
    """Number of pieces by territory, by a plain search."""
    out, seen = {}, set()
    for start in owner:
        if start not in seen:
            out[owner[start]] = out.get(owner[start], 0) + 1
            stack = [start]
            while stack:
                at = stack.pop()
                if at not in seen:
                    seen.add(at)
                    stack += [n for n in links[at] if owner[n] == owner[at]]
    return out


def test_territories_are_whole_balanced_and_better_than_blocks(spark, county):
    u, e = county
    solved = territory.solve(u, e, [3, 4], max_iterations=2)
    head = {(r["alignment"], r["n_reps"]): r for r in territory.headline(u, e, solved, 4).collect()}
    assert set(head) == {("baseline", 4), ("kmeans", 4), ("optimised", 3), ("optimised", 4)}
    for n in (3, 4):
        r = head["optimised", n]
        assert r["territories"] == n and r["contiguity_rate"] >= 0.95 and r["workload_cv"] <= 0.20
    base, best = head["baseline", 4], head["optimised", 4]
    assert best["contiguity_rate"] >= base["contiguity_rate"] and best["workload_cv"] < base["workload_cv"] and best["travel_miles"] < base["travel_miles"]
    rows = solved.collect()
    links = {}
    for r in e.collect():
        links.setdefault(r["a"], []).append(r["b"])
        links.setdefault(r["b"], []).append(r["a"])
    for n in (3, 4):
        owner = {r["zip3"]: r["territory"] for r in rows if r["n_reps"] == n}
        assert len(owner) == 36 and set(plain_pieces(owner, links).values()) == {1}


def test_moves_keep_pieces_whole_and_carry_labels(spark, county):
    u, e = county
    near = territory.neighbourhoods(u, e)
    start = territory.labelled(territory.baseline(u, 4).select("zip3", "territory").join(near, "zip3").withColumn("n_reps", F.lit(4)))
    assert {(r["zip3"], r["component"]) for r in start.collect()} == {(r["zip3"], r["component"]) for r in territory.components(start, e).collect()}
    whole = territory.repair_contiguity(start)
    after = territory.improve_balance(whole)
    same = after.select("zip3", "territory", "component").join(territory.components(after, e).select("zip3", F.col("component").alias("real")), "zip3")
    # One label is one piece.
    assert same.groupBy("component").agg(F.count_distinct("real").alias("n")).where("n > 1").isEmpty() and same.groupBy("real").agg(F.count_distinct("component").alias("n")).where("n > 1").isEmpty()
    assert territory.metrics(after).first()["workload_cv"] < territory.metrics(whole).first()["workload_cv"]


def test_rule_choice_and_leakage(spark):
    t = spark.createDataFrame([("volume", 0.5, 0.2, 100.0), ("opportunity", 0.46, 0.4, 80.0), ("model", 0.49, 0.9, 10.0)], "rule string, abs_capture double, share_capture double, median_base double")
    got = {r["rule"]: r for r in backtest.recommend_rule(t, ["opportunity", "volume"]).collect()}
    assert got["opportunity"]["recommended"] and got["model"]["metric_gamed"] and not got["model"]["recommended"]
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 7)) for i in range(50)], "y double, twice double, noise double")
    with pytest.raises(ValueError, match="twice"):
        opportunity.assert_no_leakage(df, ["twice", "noise"], "y")


def test_permutation_and_bootstrap(spark):
    from fieldlift.operators import resample

    random.seed(8)
    rows = [(i, f"s{i % 4}", x := random.gauss(0, 1), 0.4 * x + random.gauss(0, 1), random.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "npi long, s string, x double, y double, z double")
    assert resample.permutation_test(df, "s", "x", "y", reps=30).first()["p_value"] < 0.05
    assert resample.permutation_test(df, "s", "x", "z", reps=30).first()["p_value"] > 0.05
    got = {r["rule"]: r for r in resample.bootstrap_capture(df.withColumn("volume", F.lit(0.0)), {"best": "y", "volume": "z"}, "y", 60, 40).collect()}
    assert got["best"]["capture_low"] <= got["best"]["capture"] <= got["best"]["capture_high"] and got["best"]["excludes_one"]


def test_bootstrap_ranks_in_each_draw(spark):
    from fieldlift.operators import resample

    rows = [(i, float(-i), 1.0, float(i % 3), float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "npi long, score double, g double, h double, other double")
    # Everybody gains 1: lists of 10 drawn accounts have 10 in every draw, so both rules capture the same.
    for block in (4, 10_000):
        got = {r["rule"]: r for r in resample.bootstrap_capture(df, {"a": "score", "volume": "other"}, "g", 10, 30, share="h", block=block).collect()}
        a = got["a"]
        assert a["capture"] == 0.2 and (a["ratio_low"], a["ratio_high"], a["ratio_se"]) == (1, 1, 0) and not a["excludes_one"]
        assert a["share_capture"] == pytest.approx(9 / 49) and a["share_ratio"] == pytest.approx(9 / 10) and a["share_capture_se"] > 0


def test_registered_draws(spark, monkeypatch):
    from fieldlift.operators import resample
    from fieldlift.plans import registry, study

    assert "rs3_permutation_test" in registry.QUERIES
    seen = {}
    monkeypatch.setattr(resample, "permutation_test", lambda *a, **k: seen.update(k))
    monkeypatch.setattr(study.T, "holdout", lambda s, d: None)
    study.rs3_permutation_test(spark, "")
    assert seen.get("reps", 200) == 200
