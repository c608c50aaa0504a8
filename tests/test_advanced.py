"""Known answers of forecasts, matching, saturation, segments, ladders and distributions."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fieldlift.operators import blends, draws, evaluate, forecast, matching, ranks, reads, resample, segments, stats


def test_conformal_constant(spark):
    v = np.random.default_rng(1).normal(size=999)
    d = spark.createDataFrame([(i, float(x), "ab"[i % 2]) for i, x in enumerate(v)], "npi long, s double, band string")
    q = forecast.qhat(d, "s").first()["qhat"]
    assert q == pytest.approx(np.quantile(v, min(np.ceil(1000 * 0.9) / 999, 1), method="higher"))
    by = {r["band"]: (r["n"], r["qhat"]) for r in forecast.qhat(d, "s", by="band").collect()}
    for k, b in enumerate("ab"):
        own = v[k::2]
        assert by[b] == (len(own), pytest.approx(np.quantile(own, min(np.ceil((len(own) + 1) * 0.9) / len(own), 1), method="higher")))
    assert forecast.qhat(d.limit(0), "s").count() == 0


def test_quantile_and_ranks_inside_groups(spark):
    v = [3.0, 1.0, 1.0, 7.0, 2.0, 2.0, None]
    d = spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(v)], "npi long, v double, g int")
    for p in (0.0, 0.3, 0.5, 0.9, 1.0):
        assert ranks.quantile(d, "v", p).first()[0] == pytest.approx(np.quantile([x for x in v if x is not None], p))
    assert ranks.quantile(d.limit(0), "v").first()[0] is None
    got = {r["npi"]: (r["rn"], r["cum"], r["n"]) for r in ranks.rank_within(d, ["g"], [F.col("npi")], {"cum": F.col("v")}, total="n").collect()}
    assert got == {0: (1, 3.0, 3), 3: (2, 10.0, 3), 6: (3, 10.0, 3), 1: (1, 1.0, 2), 4: (2, 3.0, 2), 2: (1, 1.0, 2), 5: (2, 3.0, 2)}


def test_student_and_normal(spark):
    for t, dof, want in ((2.0, 10.0, 0.073388), (1.0, 1.0, 0.5), (0.0, 5.0, 1.0), (3.5, 120.0, 0.000653), (2.0, 2.5, 0.157392)):
        assert stats.student_p(t, dof) == pytest.approx(want, abs=5e-4)
    d = spark.createDataFrame([(0.0, 3.0), (1.959964, None)], "x double, d double")
    assert [r[0] for r in d.select(stats.normal_cdf(F.col("x"))).collect()] == pytest.approx([0.5, 0.975], abs=1e-6)
    assert [r[0] for r in d.select(stats.p_value(F.col("x"), F.col("d"))).collect()][1] is None


def test_log_odds_equal_a_plain_fit(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)) * [1, 50] + [0, 9]
    t = rng.random(300) < 1 / (1 + np.exp(-1.5 * x[:, 0] + 0.5))
    d = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), 3.0, bool(t[i])) for i in range(300)], "npi long, a double, b double, c double, t boolean")
    z = (x - x.mean(0)) / x.std(0)
    z1, w = np.column_stack([np.ones(300), z]), np.zeros(3)
    for _ in range(4000):  # plain gradient steps on the same penalised likelihood
        w += 0.01 * (z1.T @ (t - 1 / (1 + np.exp(-z1 @ w))) - [0, w[1], w[2]])
    got = {r["npi"]: r["logit"] for r in matching.propensity(d, "t", ["a", "b", "c"]).collect()}
    assert [got[i] for i in range(300)] == pytest.approx((z1 @ w).tolist(), abs=1e-6)
    assert matching.propensity(d.where("t"), "t", ["a"]).where("logit < 10").count() == 0
    assert matching.propensity(d.limit(0), "t", ["a"]).count() == 0


def test_matching_pairs_near_accounts_once(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=400)
    t = rng.random(400) < 1 / (1 + np.exp(-1.2 * x + 1))
    d = spark.createDataFrame([(i, float(x[i]), bool(t[i]), float(2 * t[i] + x[i])) for i in range(400)], "npi long, x double, t boolean, y double")
    s = matching.propensity(d, "t", ["x"]).cache()
    pairs = matching.match(s, "t")
    rows = pairs.collect()
    logit = {r["npi"]: r["logit"] for r in s.collect()}
    reach = 0.2 * np.std(list(logit.values()), ddof=1)
    a, b = [r["treated_npi"] for r in rows], [r["control_npi"] for r in rows]
    assert len(set(a)) == len(a) and len(set(b)) == len(b) and all(t[i] for i in a) and not any(t[i] for i in b)
    assert all(abs(logit[i] - logit[j]) <= reach + 1e-12 for i, j in zip(a, b, strict=True))
    free = [logit[i] for i in range(400) if not t[i] and i not in b]
    assert not [i for i in range(400) if t[i] and i not in a and any(abs(logit[i] - f) <= reach for f in free)]
    bal = matching.matched_balance(s, pairs, "t", ["x"]).first()
    assert abs(bal["smd_after"]) < abs(bal["smd_before"])
    diff = matching.paired_difference(d, pairs, "y").first()
    assert diff["pairs"] == len(rows) and diff["ci_low"] < 2 < diff["ci_high"]
    assert matching.match(s.where("t"), "t").count() == 0


def test_matching_serves_runs_at_once(spark, monkeypatch):
    """Copies, and a stretch with treated accounts only: rounds don't grow with their number."""
    scans, scan = [], matching.ranks.global_scan
    monkeypatch.setattr(matching.ranks, "global_scan", lambda *a, **k: scans.append(1) or scan(*a, **k))
    rows = [(i, i % 2 == 0, 1.0) for i in range(80)] + [(100 + i, True, 5.0 + i / 1000) for i in range(60)] + [(200 + i, False, 4.9 - i / 1000) for i in range(40)] + [(300 + i, i % 2 == 0, 9.0 + i) for i in range(4)]
    pairs = matching.match(spark.createDataFrame(rows, "npi long, t boolean, logit double"), "t").collect()
    assert len(scans) <= 4
    assert sum(r["distance"] == 0 for r in pairs) == 40 and len(pairs) == 80
    assert sorted(r["treated_npi"] for r in pairs if r["treated_npi"] >= 100) == list(range(100, 140))


@pytest.mark.parametrize(("kind", "why"), [("hill", None), ("negative", "no positive"), ("flat", "no positive"), ("far", "outside"), ("few", "too few"), ("none", "too few")])
def test_saturation(spark, kind, why):
    rng = np.random.default_rng(0)
    n = 49 if kind == "few" else 600
    pay = rng.uniform(0, 20_000, n) * (kind != "none")
    half, top, sign = (500_000, 0.5, 1) if kind == "far" else (2_000, 0.05, -1 if kind == "negative" else 0 if kind == "flat" else 1)
    y = sign * top * pay / (half + pay) + (0 if kind == "flat" else rng.normal(0, 0.0005, n))
    d = spark.createDataFrame([(i, float(p), float(v)) for i, (p, v) in enumerate(zip(pay, y, strict=True))], "npi long, pay double, delta double")
    verdict, curve = matching.saturation(d, "pay", "delta", reps=10)
    r, points = verdict.first(), curve.orderBy("amount").collect()
    if why:
        assert not r["identifiable"] and why in r["reason"] and r["half"] is None and not points
    else:
        assert r["identifiable"] and r["ceiling"] == pytest.approx(0.05, rel=0.25) and r["half"] == pytest.approx(2000, rel=0.4) and r["ninety_percent"] == pytest.approx(9 * r["half"])
        assert len(points) == 80 and all(p["low"] <= p["predicted"] + 1e-9 and p["predicted"] <= p["high"] + 1e-9 for p in points)
        assert all(x["predicted"] <= z["predicted"] for x, z in zip(points, points[1:], strict=False))


def test_power_rises_with_size_and_effect(spark):
    d = spark.createDataFrame([(0, 1.0, 100.0, 1.0), (1, 1.0, 10_000.0, 1.0), (2, 2.0, 100.0, 1.0), (3, 0.0, 100.0, 1.0), (4, 1.0, 10_000.0, 3.0)], "k int, e double, n double, deff double")
    p = {r["k"]: r["p"] for r in d.select("k", matching.power(F.col("e"), F.lit(10.0), F.col("n"), F.col("n"), F.col("deff")).alias("p")).collect()}
    assert p[1] > p[0] and p[2] > p[0] and p[3] < 0.03 and p[4] < p[1]


def test_rand_index_and_labels(spark):
    d = spark.createDataFrame([(i, i // 10, (i // 10 + 1) % 3, i % 7) for i in range(30)], "npi long, a int, b int, c int")
    assert segments.agreement(d, "a", "b").first()["ari"] == pytest.approx(1.0)
    assert abs(segments.agreement(d, "a", "c").first()["ari"]) < 0.2


def test_noise_ceiling_is_near_hindsight_for_large_counts(spark):
    def share(scale):
        rng = np.random.default_rng(2)
        rows = []
        for i in range(800):
            n = int(rng.integers(20, 60) * scale) + 1
            y = int(rng.binomial(n, rng.uniform(0.1, 0.9)))
            rows.append((i, "g", 0.3, 100.0, float(n), float(y)))
        d = spark.createDataFrame(rows, "npi long, specialty_group string, eb_share double, class_fills double, class_obs_next double, brand_fills_next double")
        priors = spark.createDataFrame([("g", 1.0, 1.0)], "specialty_group string, a double, b double")
        d = stats.shrink(d, priors, "specialty_group", "brand_fills_next", "class_obs_next", "nx").withColumn("eb_share_fills", (F.col("nx") - F.col("eb_share")) * F.col("class_fills")).drop("nx")
        r = evaluate.noise_ceiling(d, priors, 200, reps=5).first()
        return r["noise_ceiling"] / r["hindsight"]

    large, small = share(100), share(0.05)
    assert large > 0.9 and small < large


def test_shuffles_stay_inside_strata(spark):
    d = spark.createDataFrame([(i, i % 3, float(i % 3)) for i in range(90)], "npi long, s int, v double")
    d = d.withColumn("u", F.col("npi") * 1.0)
    rows = resample.shuffled(d, "u", 6, 1, stratum="s", carry=["v"]).collect()
    assert len(rows) == 7 * 90 and all(r["u"] % 3 == r["v"] for r in rows)
    by = {rep: {r["npi"]: r["u"] for r in rows if r["rep"] == rep} for rep in range(7)}
    assert by[0] == {i: float(i) for i in range(90)}
    for rep in range(1, 7):
        assert sorted(by[rep].values()) == [float(i) for i in range(90)]
        # Strata of one size are permuted differently.
        assert [by[rep][i] for i in range(0, 90, 3)] != [by[rep][i] - 1 for i in range(1, 90, 3)]
    assert len({tuple(sorted(x.items())) for x in by.values()}) == 7


def test_permutations_are_exact_and_even():
    for size in (1, 2, 3, 5, 16, 17, 100, 1025):
        for draw in (1, 2, 9):
            assert sorted(draws.permuted(np.arange(size), size, draw, 7).tolist()) == list(range(size))
    # Every place is as likely as any other.
    seen = np.bincount(np.concatenate([draws.permuted(np.array([3]), 10, r, 1) for r in range(6000)]), minlength=10)
    assert ((seen - 600) ** 2 / 600).sum() < 27.9  # chi-square of 9 degrees at 0.001


def chi_square(got, chances, n):
    """Statistic over outcomes with at least five expected hits, the rest pooled; and its degrees of freedom."""
    want = np.array(chances) * n
    big = want >= 5
    seen = np.bincount(got.astype(int), minlength=len(want))[: len(want)]
    o, e = np.append(seen[big], n - seen[big].sum()), np.append(want[big], n - want[big].sum())
    use = e > 1e-9
    return ((o[use] - e[use]) ** 2 / e[use]).sum(), use.sum() - 1


def test_counts_follow_their_distributions():
    n = 40_000
    u = draws.uniforms(np.arange(n), 3)
    assert abs(u.mean() - 0.5) < 0.01 and 0 < u.min() and u.max() < 1
    for mean in (0.0, 0.3, 4.0, 37.5, 900.0):
        got = draws.poisson(np.full(n, mean), u)
        chances = [math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) if mean else float(k == 0) for k in range(int(mean + 12 * mean**0.5 + 20))]
        stat, dof = chi_square(got, chances, n)
        assert stat < dof + 4 * (2 * max(dof, 1)) ** 0.5
    for size, p in ((0, 0.4), (1, 0.5), (7, 0.0), (7, 1.0), (20, 0.03), (300, 0.5), (1000, 0.97)):
        got = draws.binomial(np.full(n, float(size)), np.full(n, p), u)
        chances = [math.comb(size, k) * p**k * (1 - p) ** (size - k) for k in range(size + 1)]
        stat, dof = chi_square(got, chances, n)
        assert stat < dof + 4 * (2 * max(dof, 1)) ** 0.5 and got.max() <= size
    m = draws.poisson_one(np.arange(n), np.array([0, 5]))
    assert (m[:, 0] == 1).all() and abs(m[:, 1].mean() - 1) < 0.02 and abs(m[:, 1].var() - 1) < 0.05


def test_bootstrap_equals_a_plain_run_of_the_same_draws(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.integers(0, 30)), float(rng.normal()), float(rng.normal())) for i in range(500)]
    d = spark.createDataFrame(rows, "npi long, a double, b double, g double").repartition(7)
    keys = {r["npi"]: r["h"] for r in d.select("npi", F.xxhash64("npi", F.lit(5)).alias("h")).collect()}
    reps, k = 50, 60
    m = draws.poisson_one(np.array([keys[i] for i in range(500)]), np.arange(reps + 1)).astype(int)
    gain = np.maximum([r[3] for r in rows], 0)
    capture = {}
    for name, at in (("a", 1), ("b", 2)):
        order = sorted(range(500), key=lambda i: (-rows[i][at], i))
        before = np.cumsum(m[order], 0) - m[order]
        take = np.clip(k - before, 0, m[order])
        capture[name] = (gain[order] @ take) / (gain @ m)
    for block in (16, 10_000):
        got = {r["rule"]: r for r in resample.bootstrap_capture(d, {"a": "a", "b": "b"}, "g", k, reps, baseline="b", block=block).collect()}
        for name in ("a", "b"):
            want = capture[name]
            assert got[name]["capture"] == pytest.approx(want[0])
            assert (got[name]["capture_low"], got[name]["capture_high"]) == pytest.approx(tuple(np.percentile(want[1:], [2.5, 97.5])))
            assert got[name]["ratio_se"] == pytest.approx(np.std((want / capture["b"])[1:], ddof=1))


def test_silhouette_equals_a_plain_one(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(50, 2)) + 8, [[30.0, 30.0]]])
    two, three = [0] * 60 + [1] * 51, [i % 3 for i in range(110)] + [7]
    rows = spark.createDataFrame([(i, x[i].tolist(), two[i], three[i]) for i in range(111)], "npi long, x array<double>, a int, b int").select("npi", array_to_vector("x").alias("z"), "a", "b")
    got = {r["name"]: r["silhouette"] for r in segments.silhouette(rows, ["a", "b"]).collect()}
    far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for name, label in (("a", np.array(two)), ("b", np.array(three))):
        s = []
        for i in range(111):
            own = label == label[i]
            inner = far[i][own].sum() / max(own.sum() - 1, 1)
            outer = min(far[i][label == c].mean() for c in set(label.tolist()) - {label[i]})
            s.append((outer - inner) / max(outer, inner) if own.sum() > 1 else 0.0)
        assert got[name] == pytest.approx(np.mean(s))
    assert segments.silhouette(rows, ["a"], rows=20).first()["silhouette"] > 0.5
    assert segments.silhouette(rows.limit(0), ["a"]).first()["silhouette"] is None


def test_values_of_conditions_stay_values(spark):
    d = spark.createDataFrame([(1, "it's", 5.0), (2, "' OR 1 = 1 --", 7.0), (3, None, 9.0), (4, "x", None)], "npi long, `na``me` string, v double")
    ids = lambda *c: sorted(r["npi"] for r in reads.filtered(d, [reads.Condition(*x) for x in c]).collect())
    assert ids(("na`me", "=", "' OR 1 = 1 --")) == [2]
    assert ids(("na`me", "in", ["it's", "x", "nothing"])) == [1, 4]
    assert ids(("na`me", "like", "%'%"), ("v", ">", 5)) == [2]
    assert ids(("v", "from last", 0.7)) == [2, 3] and ids() == [1, 2, 3, 4] and ids(("v", "<=", 5.0)) == [1]
    for bad in (("no", "=", 1), ("v", "= 1 OR", 1)):
        with pytest.raises(ValueError, match="no column|can't ask"):
            ids(bad)


@pytest.mark.parametrize("k", [40, 5000])
def test_blends_equal_a_plain_bootstrap(spark, k, monkeypatch):
    monkeypatch.setattr(blends, "LEVELS", 16)
    rng = np.random.default_rng(9)
    n, reps, weights = 260, 30, [0.0, 0.35, 1.0]
    o, v = rng.gamma(2, size=n), np.round(rng.gamma(2, size=n), 1)
    ga, gs = rng.normal(size=n) + 0.2 * v, rng.normal(size=n) + 0.2 * o
    d = spark.createDataFrame([(i, float(o[i]), float(v[i]), float(ga[i]), float(gs[i])) for i in range(n)], "npi long, opportunity double, class_fills double, growth_abs double, growth_share double").repartition(5)
    h = {r["npi"]: r["h"] for r in d.select("npi", F.xxhash64("npi", F.lit(7)).alias("h")).collect()}
    m = draws.poisson_one(np.array([h[i] for i in range(n)]), np.arange(reps + 1)).astype(int)
    ratio = {w: np.empty((2, reps + 1)) for w in weights}
    for r in range(reps + 1):
        rank = lambda x: np.array([(m[x < a, r].sum() + (m[x == a, r].sum() + 1) / 2) / m[:, r].sum() for a in x])  # noqa: B023, E731
        ro, rv = rank(o), rank(v)
        got = {}
        for w in weights:
            order = np.lexsort((np.arange(n), np.round(-(w * ro + (1 - w) * rv), 12)))
            before = np.cumsum(m[order, r]) - m[order, r]
            take = np.clip(k - before, 0, m[order, r])
            got[w] = np.array([np.maximum(g, 0)[order] @ take for g in (ga, gs)])
        for w in weights:
            ratio[w][:, r] = got[w] / got[0.0]
    rows = {r["weight"]: r for r in blends.bootstrap_frontier(d, k, weights, reps=reps, blocks=20).collect()}
    for w in weights:
        a, s = ratio[w]
        assert rows[w]["abs_ratio"] == pytest.approx(a[0]) and rows[w]["share_ratio"] == pytest.approx(s[0])
        assert (rows[w]["abs_ratio_low"], rows[w]["share_ratio_high"]) == pytest.approx((np.percentile(a[1:], 2.5), np.percentile(s[1:], 97.5)))
        assert rows[w]["p_clears_floor"] == pytest.approx(round(np.mean(a[1:] >= 0.9), 2), abs=0.011)
    assert blends.robust_weight(spark.createDataFrame([(0.0, 1.0, 1.0), (0.5, 1.2, 0.97), (1.0, 2.0, 0.1)], "weight double, share_ratio double, p_clears_floor double")).first()[0] == 0.5
