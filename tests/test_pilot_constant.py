"""A pilot list whose accounts all changed alike in the year before."""

from fieldlift.operators import matching


def test_a_constant_year_before_has_no_correlation(spark):
    rows = [(str(i % 4), 10.0 + i, 20.0, float(i % 5), float(i % 7), 0.0, float(i % 7) / 2) for i in range(40)]
    listed = spark.createDataFrame(rows, "territory string, opportunity double, class_fills double, growth_share double, growth_abs double, prior_growth_share double, prior_growth_abs double")
    got = {r["endpoint"]: r for r in matching.pilot_inputs(listed, 0.2, 12.0, 12.0).collect()}
    assert got["share"]["rho"] == 0.0 and abs(got["fills"]["rho"] - 1) < 1e-9 and got["share"]["listed"] == 40
