"""Every registered query against its SQL check on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from tools.check import canon, connect

QUERIES = entry_module.queries()
CHECKS = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = con.execute(CHECKS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canon(got), canon(want)
    assert len(a) == len(b)
    assert [x for x in zip(a, b) if x[0] != x[1]] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 20 and rows[0]["n"] >= rows[1]["n"]


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)
