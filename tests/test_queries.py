"""Every query with SQL returns the rows that DuckDB returns; every other query runs."""

from __future__ import annotations

import math
import re

import duckdb
import pytest

from leafmill.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    expected = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    at = [expected.columns.index(c) for c in columns]
    a = sorted(tuple(norm(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(norm(r[i]) for i in at) for r in expected.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    df.collect()


def test_entry_counts_every_page_with_a_term(spark, sf):
    import __spark_entry__ as e

    terms = ("the", "license", "ing of", "que")
    texts = [r["text"].lower() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sum(r["n_total"] for r in e.entry(spark).collect()) == sum(any(x in t for x in terms) for t in texts)


@pytest.mark.parametrize("name", ["regex_isin_extract", "provenance_whole", "provenance_slice"])
def test_codes_are_words_of_any_script(spark, tmp_path, name):
    texts = [
        "the ÉENAITREOIAUX", "the ABCDEFGHIJ12é", "the \U0001d400ABCDEFGHIJ12", "the \u0660ABCDEFGHIJ12", "the _ABCDEFGHIJ12", "the E\u0301ABCDEFGHIJ12",
        "the ABCDEFGHIJ12 ABCDEFGHIJ13,ABCDEFGHIJ14—ABCDEFGHIJ15🙂ABCDEFGHIJ16", "ABCDEFGHIJ12", "the\nABCDEFGHIJ12\n", "que ABCDEFGHIJKLM", "", None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    frame = QUERIES[name](spark, str(tmp_path))
    got = sorted(map(tuple, frame.collect()))
    assert got == sorted(con.sql(f"SELECT {', '.join(frame.columns)} FROM ({SQL[name]})").fetchall())
    if name == "regex_isin_extract":
        want = [(k, m) for k, t in enumerate(texts) for m in re.findall(r"\b([A-Z]{2}[A-Z0-9]{10})\b", t or "")]
        assert [(page, code) for page, _, code in got] == want


def test_every_code_teaches(spark, tmp_path):
    text = "ABC123456789 then DEF123456789 and ABC000000000"
    spark.createDataFrame([(1, text), (2, "DEF999999999"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["term"], r["ord"]) for r in QUERIES["learned_terms_whole"](spark, str(tmp_path)).collect()}
    assert got == {("ABC", 1), ("DEF", 1)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_reconciled_orders_are_dealt_by_their_number(spark, sf, monkeypatch):
    """More rows make more parts, so a task's memory doesn't grow with the tables."""
    from leafmill import session
    from leafmill.plans import graph_queries

    held = []

    def recorded(df, name):
        held.append(df.rdd.getNumPartitions())
        return session.materialize(df, name)

    monkeypatch.setattr(graph_queries, "materialize", recorded, raising=False)
    for size in (session.ROWS_A_PART, 250):
        monkeypatch.setattr(session, "ROWS_A_PART", size)
        graph_queries.reconciliation_issues(spark, sf)
    rows = sum(session.read_table(spark, sf, t).count() for t in ("orders", "lineitem", "customer"))
    assert held == [spark.sparkContext.defaultParallelism, -(-rows // 250)]
