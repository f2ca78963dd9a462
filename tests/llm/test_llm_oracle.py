from __future__ import annotations

import compare
import pytest

from rainledger.llm import oracle, queries

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(oracle.SQL))
def test_query_against_sql(spark, name):
    assert compare.difference(spark, compare.connect(SMALL), SMALL, name) is None


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
