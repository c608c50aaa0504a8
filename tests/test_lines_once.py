"""The order lines are joined once a query, and the deciles of a period are scanned from rows that were made before."""

from fieldlift.plans import fixture as T


def test_a_query_joins_the_order_lines_once(spark, monkeypatch):
    asked, table = [], T.table
    monkeypatch.setattr(T, "table", lambda s, d, name: asked.append(name) or table(s, d, name))
    d = "/root/testdata/sf0.001"
    with T.making():
        rows, people = T.all_rows(spark, d), T.provider(spark, d)
        links = T.lines(spark, d).select("npi", "l_suppkey")
    assert asked.count("lineitem") == 1
    lines = T.lines(spark, d)
    assert rows.groupBy().sum("tot_clms").first()[0] == people.groupBy().sum("all_drug_clms").first()[0] == links.count() == lines.count()
    want = lines.select("npi", "year", "l_orderkey").distinct().groupBy("npi", "year").count()
    assert sorted(map(tuple, people.selectExpr("npi", "year", "cast(panel_benes as long)").collect())) == sorted(map(tuple, want.collect()))
