"""Short lists are cut in every task."""

import contextlib
import io

from pyspark.sql import functions as F

from fieldlift.operators import ranks


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_a_short_list_is_cut_in_every_task(spark):
    df = spark.range(4000).select(F.col("id").alias("npi"), F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("rule"), F.when(F.col("id") % 50 != 0, (F.col("id") * 7919 % 97).cast("double")).alias("score"))
    short = ranks.top_k_by_rule(df, 40)
    assert "WindowGroupLimit" in _plan(short)
    scanned = ranks.rank_within(df, ["rule"], [F.col("score").desc_nulls_last(), F.col("npi")], rank="position").where("position <= 40")
    assert dict(short.dtypes) == dict(scanned.dtypes)
    columns = ["npi", "rule", "score", "position"]
    assert sorted(short.select(columns).collect()) == sorted(scanned.select(columns).collect())
    assert short.count() == 120 and ranks.top_k_by_rule(df, ranks.SHORT + 1).count() == 3 * 1001
