"""Numbered queries with SQL return the rows that DuckDB returns."""

from __future__ import annotations

import duckdb
import pytest

from leafmill.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, expected = registry.QUERIES[name](spark, sf), con.sql(registry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(
        repr(tuple(r[i] for i in at)) for r in expected.fetchall()
    )
