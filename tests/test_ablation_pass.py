"""Frontiers of several variants are predicted together."""

from pyspark.sql import functions as F

from fieldlift.operators import explain, models


def test_frontiers_are_predicted_in_one_pass(spark, monkeypatch):
    """All variants of an ablation share one preparation of features, and predict what each of them predicts alone."""
    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    df = spark.range(600).select(F.col("id").alias("npi"), F.lit(1999).alias("year"), (5 + 50 * h).alias("panel_benes"), (1 + 400 * h).alias("non_class_clms"), (1 + h).alias("risk_score"), F.lit(100.0).alias("zip3_population"), F.lit(3.0).alias("zip3_pop_density"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("specialty_group"), F.lit("R").alias("region"), F.when(F.col("id") % 9 != 0, 2 + 60 * h * (1 + F.col("id") % 2)).otherwise(0.0).alias("class_fills"), (1 + 5 * h).alias("brand_fills"))
    variants = {"production": {}, "no specialty": {"flatten": ("specialty_group",)}, "median": {"tau": 0.5}, "national": {"national": True}}
    made = models.fit_frontiers(df, {n: {k: v for k, v in spec.items() if k != "national"} for n, spec in variants.items()}, trees=5)
    together = models.predict_frontiers(df, made)
    for name, one in made.items():
        both = together.select("npi", F.col(f"`{name}`").alias("f")).join(one.predict(df), "npi")
        assert both.count() == 600 and both.where("f <> frontier").count() == 0
    asked, framed, fit = [], models.feature_frame, models.fit_frontiers
    monkeypatch.setattr(models, "feature_frame", lambda d: asked.append(1) or framed(d))
    monkeypatch.setattr(models, "fit_frontiers", lambda d, v: fit(d, v, trees=5))
    bench = spark.createDataFrame([("A", "R", 1999, 0.5), ("B", "R", 1999, 0.6)], "specialty_group string, region string, year int, achievable_share double")
    outcomes = df.where("class_fills > 0").select("npi", "class_fills", F.col("brand_fills").alias("growth_abs"), F.col("brand_fills").alias("eb_share_fills"))
    rows = {r["variant"]: r for r in explain.ablation(df, bench, outcomes, 30, variants).collect()}
    assert set(rows) == set(variants) and len(asked) == 2  # the fit's and the prediction's
    assert abs(rows["production"]["spearman_vs_production"] - 1) < 1e-12 and rows["production"]["value_capture_change"] == 0
