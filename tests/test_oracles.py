"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from postlake.plans import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["domain", "postings"] and df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, note
