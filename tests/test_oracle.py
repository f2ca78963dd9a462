"""Every query with a SQL counterpart, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from rainledger.plans import oracle, queries

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(DIRECTORY)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert compare.difference(spark, con, DIRECTORY, name) is None


def test_every_query_has_its_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
