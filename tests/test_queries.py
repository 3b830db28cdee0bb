"""Queries against DuckDB on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from factmill import operator_queries, queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or v != v:
        return ""
    return f"{float(v):.9g}" if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    got = query(spark, sf_dir)
    columns = sorted(got.columns)
    assert columns == sorted(names)
    want = [[row[names.index(c)] for c in columns] for row in result.fetchall()]
    assert sorted([shown(r[c]) for c in columns] for r in got.collect()) == sorted([shown(v) for v in row] for row in want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, tiny, name):
    compare(spark, tiny, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_without_oracle(spark, tiny):
    for name in ("bootstrap_ci", "element_merge", "detection_matching", "context_admission", "box_union_eps"):
        assert queries.QUERIES[name](spark, tiny).count() > 0
