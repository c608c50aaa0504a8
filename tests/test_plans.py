"""How registered queries read the bound tables."""

import os

import pytest

from fieldlift.plans import fixture, registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_a_query_reads_the_order_lines_twice_at_most(spark, monkeypatch):
    """Once for the providers and once for the products, however often the mart is asked for; nothing is kept for the next query."""
    read, lines = [], fixture.lines
    monkeypatch.setattr(fixture, "lines", lambda *a: read.append(a) or lines(*a))
    for n in (1, 2):
        assert registry.QUERIES["ev14_segment_panel"](spark, DATA).count() > 0
        assert len(read) == 2 * n
    assert fixture.mart(spark, DATA).columns == fixture.mart(spark, DATA).columns and len(read) > 4
    with fixture.making():
        assert fixture.mart(spark, DATA) is fixture.mart(spark, DATA)
        assert fixture.scored(spark, DATA) is fixture.scored(spark, DATA, fixture.FIT)
        assert fixture.scored(spark, DATA, 1998) is not fixture.scored(spark, DATA)
