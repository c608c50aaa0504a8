"""What is written of a panel is what the models and the metrics of lists read."""

from pyspark.sql import functions as F

from fieldlift.operators import evaluate, models


def _panel(spark):
    n = F.col("npi").cast("double")
    numbers = {"panel_benes": n, "non_class_clms": n * 2, "risk_score": 1 + n / 100, "class_fills": 5 + n, "brand_fills": n % 7, "brand_share": (n % 7) / (5 + n), "opportunity": n % 13, "growth_abs": n % 5 - 2, "growth_share": (n % 5 - 2) / 10, "eb_growth_share": (n % 3 - 1) / 10, "eb_share_fills": n % 11 - 5, "momentum": n % 4}
    named = {"specialty_group": F.concat(F.lit("g"), F.col("npi") % 3), "region": F.lit("r")}
    return spark.range(400).withColumnRenamed("id", "npi").withColumns(numbers | named)


def test_wide_panels_give_the_same_ladder_and_are_not_written(spark):
    panel = _panel(spark)
    wide = panel.withColumns({f"other{k}": F.lit(k) for k in range(30)})
    made, rules = evaluate.ladder_panel(wide, wide)
    assert not [c for c in made.columns if c.startswith("other")]
    assert set(made.columns) >= {"npi", "class_fills", *evaluate.OUTCOMES, *rules.values()}
    again = evaluate.rule_metrics(wide.join(made.select("npi", "hybrid", "random", "gbm_abs", "gbm_share_raw", "gbm_value"), "npi"), rules, 40)
    assert sorted(map(repr, evaluate.rule_metrics(made, rules, 40).collect())) == sorted(map(repr, again.collect()))


def test_states_keep_what_is_there(spark):
    got = models.state_columns(_panel(spark).withColumn("other", F.lit(1)), ["momentum", "not there"]).columns
    assert "other" not in got and "not there" not in got and got[0] == "npi" and got[-1] == "momentum"
