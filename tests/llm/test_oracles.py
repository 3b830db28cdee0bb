"""Queries that SQL can express against DuckDB on the smallest tables."""

import pytest
from test_queries import compare

from factmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, tiny, name):
    compare(spark, tiny, queries.QUERIES[name], queries.ORACLE_SQL[name])
