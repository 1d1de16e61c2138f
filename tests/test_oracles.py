"""Every query with SQL against that SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from sessionlens.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLES[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
