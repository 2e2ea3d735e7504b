"""Relations in three orders: patterns, plans and odd rows."""

from __future__ import annotations

import itertools
import re

import pytest
from pyspark.sql import functions as F

from leafmill.session import _named
from leafmill.sources import triples

ROWS = [(s, f"t{s * o % 3}", o, s + o) for s in range(40) for o in range(30) if (s + o) % 4] + [(1, None, 2, 0), (None, "t1", 2, 0), (1, "t2", 2, 9), (1, "t2", 2, 9)]


@pytest.fixture(scope="module")
def store(spark):
    relations = spark.createDataFrame(ROWS, "subject int, type string, object int, n int").repartition(3)
    out = triples.write(relations, 8, 2)
    yield out
    out.drop()
    assert not set(out.paths) & set(_named)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_all_patterns(store):
    for s, t, o in itertools.product((None, 1, 77), (None, "t2", "x"), (None, 2)):
        want = [r for r in ROWS if (s is None or r[0] == s) and (t is None or r[1] == t) and (o is None or r[2] == o)]
        got = store.query(s, t, o)
        assert got.columns == ["subject", "type", "object", "n"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("ends", [(1, None, None), (None, None, 2), (1, "t2", 2), (1, None, 2), (None, "t2", 2), (1, "t2", None)])
def test_a_lookup_reads_one_bucket(spark, store, ends):
    # With it on, Spark prunes the buckets all the same and only leaves the count out of the plan.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 8" in plan(store.query(*ends))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert store.query(*ends).select(F.input_file_name()).distinct().count() <= 1


def test_a_type_reads_its_partition(store):
    told = plan(store.query(type_="t2"))
    assert re.search(r"PartitionFilters: \[[^]]*\(type#\d+ = t2\)", told) and store.by_type in told


def test_joins_by_an_end_leave_the_store_where_it_is(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for end, table in (("subject", store.by_subject), ("object", store.by_object)):
            other = spark.range(50).select(F.col("id").cast("int").alias(end), F.lit("x").alias("mark"))
            joined = other.join(spark.table(table), end)
            told = joined._jdf.queryExecution().executedPlan().toString()
            assert told.count("Exchange hashpartitioning") == 1
            both = spark.table(table).withColumnRenamed("n", "m").join(spark.table(table), end)
            assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
            assert joined.count() == sum(r[0 if end == "subject" else 2] is not None for r in ROWS)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_table(spark):
    none = triples.write(spark.createDataFrame([], "subject int, type string, object int"), 2)
    assert none.query().count() == 0 and none.query(1, "x", 2).count() == 0
    none.drop()
