"""The queries with SQL against DuckDB."""

import pytest

import oracle
from cartograph.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert oracle.difference(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.01") == ""
