"""Scratch tables: each job removes its own, wherever it runs."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from types import SimpleNamespace

import pytest

from leafmill import session


def _tables(spark):
    return {x.name for x in Path(session.scratch_dir(spark).removeprefix("file://")).iterdir()}


def test_jobs_in_threads_keep_their_own_tables(spark):
    before = _tables(spark)

    def work(k):
        def inner():
            step = session.materialize(spark.range(k + 1), f"step{k}")
            nested = session.in_job(f"nested{k}", lambda: session.materialize(step.selectExpr("id + 1 AS id"), f"deep{k}"))
            return nested.selectExpr("id * 2 AS id")

        return session.in_job(f"result{k}", inner)

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(work, range(8)))
    assert [x.count() for x in found] == list(range(1, 9))
    new = {x.split("-")[1] for x in _tables(spark) - before}
    assert new == {f"result{k}" for k in range(8)}


def test_a_failed_job_leaves_nothing(spark):
    before = _tables(spark)

    def work():
        session.materialize(spark.range(3), "step")
        raise KeyError("x")

    with pytest.raises(KeyError):
        session.in_job("result", work)
    assert _tables(spark) == before


def test_a_cluster_needs_a_shared_folder():
    unset = SimpleNamespace(get=lambda key, default: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(ValueError, match="share"):
            session.scratch_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master)))
    named = SimpleNamespace(get=lambda key, default: "s3://shared")
    assert session.scratch_dir(SimpleNamespace(conf=named)) == "s3://shared"


def test_the_session_keeps_its_settings(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    session.materialize(spark.range(1), "one")
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def _shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {x for folder in folders for x in Path(folder.getPath()).rglob("shuffle_*.data")}


def test_shuffle_files_go_with_their_table(spark):
    before = _shuffle_files(spark)
    for k in range(3):
        session.materialize(spark.range(10_000).repartition(5, "id").groupBy("id").count(), f"dealt{k}")
    for _ in range(50):  # Spark removes them in the background
        if _shuffle_files(spark) <= before:
            return
        time.sleep(0.1)
    raise AssertionError(_shuffle_files(spark) - before)


def test_threads_put_the_setting_back(spark):
    before = spark.conf.get(session._TIDY, None)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: session.materialize(spark.range(k + 1), f"tidy{k}"), range(8)))
    assert spark.conf.get(session._TIDY, None) == before and not session._tidying


def test_a_dropped_table_is_gone_before_its_job_ends(spark):
    before = _tables(spark)

    def work():
        step = session.materialize(spark.range(3), "step")
        session.drop(step)
        assert _tables(spark) == before
        return spark.range(2)

    assert session.in_job("result", work).count() == 2
