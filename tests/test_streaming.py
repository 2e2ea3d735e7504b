"""Streams end in the state that a batch gives."""

from __future__ import annotations

import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from leafmill.operators import resolve
from leafmill.plans.graph_queries import _facts
from leafmill.functions.facts import Fact, fold
from leafmill.streaming.facts import PROVIDER, folded_facts
from leafmill.streaming.store import bucket_of, entity_rows, first_rows, merge_batch, sink, stored
from leafmill.streaming.upsert import entity_updates, windowed


def run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_entities(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    writes = events.select(F.col("user_id").alias("key"), F.dayofyear("ts").alias("page"), F.col("value").alias("confidence"), F.col("event_id").alias("ord"))
    writes.repartition(3).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "w"))
    run(entity_updates(stream), "entities", "complete")
    got = sorted(map(tuple, spark.table("entities").collect()))
    assert got == sorted(map(tuple, entity_updates(writes).collect()))


def test_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value")
    events.repartition(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    run(windowed(stream), "windows", "complete")
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_facts_in_any_order_and_over_a_restart(spark, sf, tmp_path, rocks):
    facts = _facts(spark, sf).withColumn("at", F.timestamp_seconds(F.col("ord") * 60 + 60))
    rows = facts.collect()
    n = len(rows)
    # Three files of facts that lie within the watermark's delay of one another, each shuffled, then one that ends all waiting.
    rng = random.Random(4)
    ordered = sorted(rows, key=lambda r: r["ord"] + rng.uniform(0, n / 6))
    end = [(-1, "end", 10**7, "x", 0.5, 1, "toc", rows[0]["at"] + timedelta(days=400))]
    batches = [ordered[: n // 3], ordered[n // 3 : 2 * n // 3], ordered[2 * n // 3 :]]
    folder = tmp_path / "facts"

    def run_once():
        stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        told = folded_facts(stream, late=f"{n} minutes")
        q = told.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).format("parquet").start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()

    for k, batch in enumerate([*batches, end]):
        rng.shuffle(batch)
        spark.createDataFrame(batch, facts.schema).coalesce(1).write.mode("append").parquet(str(folder))
        if k in (1, 3):  # a query that stops in between goes on from its checkpoint
            run_once()
    run_once()
    audit = spark.read.parquet(str(tmp_path / "out")).where("field <> 'end'")
    assert audit.count() == n
    last = audit.groupBy("key", "field").agg(F.max_by(F.struct(*audit.columns[5:]), "ord").alias("x")).select("key", "field", "x.*").collect()
    want = {(r["key"], r["field"]): r for r in resolve.fold_facts(_facts(spark, sf)).collect()}
    assert len(last) == len(want)
    for r in last:
        w = want[r["key"], r["field"]]
        assert all(r[c] == w[c] for c in ("value", "confidence", "page", "by_confidence", "by_source", "by_page", "by_default"))
        assert sum(r[c] for c in r.__fields__ if c.startswith("by_")) == w["n_conflicts"]


def test_every_rule_of_the_fold():
    known, why = fold(None, Fact(1, 1, "a", 0.5, 1, "toc"))
    for fact, reason, value in [
        (Fact(2, 2, "a", 0.6, 5, None), "same", "a"), (Fact(3, 3, "b", 0.95, 2, "toc"), "by_confidence", "b"), (Fact(4, 4, "c", 0.1, 2, "toc"), "by_confidence", "b"),
        (Fact(5, 5, "c", 0.9, 2, "inferred"), "by_source", "b"), (Fact(6, 6, "c", 0.9, 13, "toc"), "by_page", "c"), (Fact(7, 7, "d", 0.9, 3, "toc"), "by_default", "d"),
    ]:
        known, why = fold(known, fact)
        assert (why, known.value) == (reason, value)
    assert (known.confidence, known.page, known[4:]) == (0.95, 3, (2, 1, 1, 1))


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_batches_rewrite_their_own_buckets_once(spark, tmp_path):
    path, at = str(tmp_path / "store"), tmp_path / "store"
    kind = "key string, pages array<int>, confidence double, name string, ord long, n_writes long"
    one = spark.createDataFrame([(f"k{k}", [k % 5], k / 100, f"n{k}", k, 1) for k in range(60)] + [(None, [1], 0.1, "none", 99, 1)], kind)
    two = spark.createDataFrame([("k1", [9], 0.9, "again", 200, 1), ("k1", [8], 0.2, "late", 150, 1), ("new", [1], 0.5, "new", 201, 1), (None, [2], 0.3, "x", 98, 1)], kind)
    assert merge_batch(one, 1, path, ("key",), entity_rows, 16)
    first = files(at)
    changed = merge_batch(two, 2, path, ("key",), entity_rows, 16)
    second = files(at)
    kept = {f for f in first if int(re.search(r"bucket=(\d+)", f)[1]) not in changed}
    assert kept and kept <= second and len(changed) <= 3 and not (first - kept) & second

    def rows():
        return {r["key"]: tuple(r) for r in stored(spark, path, one).collect()}

    want = {r["key"]: tuple(r) for r in entity_rows(one, two).collect()}
    assert rows() == want and want["k1"] == ("k1", [1, 8, 9], 0.9, "again", 200, 3) and want[None][-1] == 2
    # The same batch again, and an empty one, change nothing.
    assert merge_batch(two, 2, path, ("key",), entity_rows, 16) == [] and merge_batch(two.limit(0), 3, path, ("key",), entity_rows, 16) == []
    assert files(at) == second
    # A batch that fails leaves the old table, and its repetition counts.
    poor = two.withColumn("confidence", F.when(F.col("key") == "new", F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("confidence")))
    with pytest.raises(Exception, match="broken"):
        merge_batch(poor, 4, path, ("key",), entity_rows, 16)
    assert files(at) == second and rows() == want
    merge_batch(two, 4, path, ("key",), entity_rows, 16)
    assert rows()["k1"][-1] == 5


def test_a_half_done_batch_is_finished_by_its_repetition(spark, tmp_path):
    path = str(tmp_path / "half")
    kind = "key string, pages array<int>, confidence double, name string, ord long, n_writes long"
    rows = [(f"k{k}", [1], 0.5, "n", k, 1) for k in range(40)]
    frame = spark.createDataFrame(rows, kind)
    merge_batch(frame, 1, path, ("key",), entity_rows, 8)
    half = frame.where(bucket_of(("key",), 8) < 4)
    merge_batch(half, 2, path, ("key",), entity_rows, 8)
    merge_batch(frame, 2, path, ("key",), entity_rows, 8)
    assert [r["n_writes"] for r in stored(spark, path, frame).collect()] == [2] * 40


def test_discovered_fields_follow_a_stream(spark, sf, tmp_path):
    kind = "field_name string, value string, ord long"
    for k, rows in enumerate([[("a", "1", 1), ("a", "2", 0), ("b", "1", 5)], [("b", "9", 0), ("c", "1", 9)], [("a", "7", 1)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(sink(str(tmp_path / "fields"), ("field_name",), first_rows(("field_name",), "ord"), 4))
        q = q.option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()
    got = stored(spark, str(tmp_path / "fields"), spark.createDataFrame([], kind)).collect()
    assert sorted(map(tuple, got)) == [("a", "2", 0), ("b", "1", 5), ("c", "1", 9)]
