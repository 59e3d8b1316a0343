"""Every query with SQL against that SQL; the others give rows; order of input does not matter."""

import pytest

import __spark_entry__ as entry
from loamstack.plans import golden_queries, record_queries, search_queries
from oracle import compare, rows

SF = "/root/testdata/sf0.001"
OWN = {**search_queries.QUERIES, **record_queries.QUERIES, **golden_queries.QUERIES}
SQL = {**search_queries.SQL, **record_queries.SQL, **golden_queries.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, name):
    compare(spark, OWN[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_gives_rows(spark, name):
    got = OWN[name](spark, SF)
    assert got.count() > 0
    assert rows(got.columns, got.collect()) == rows(got.columns, OWN[name](spark, SF).collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
