"""The quality classifier against plain Python and numpy, and what it brings to the driver."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from leafmill.llm import registry, rule_ensemble


def statistics(text):
    text = text or ""
    count = lambda pattern: float(len(re.findall(pattern, text)))
    words, chars = count(r"[^\x20\x09-\x0D]+"), float(len(text))
    n = max(words, 1.0)
    tokens, lines = text.split(" "), text.split("\n")
    doubled = len(list(re.finditer(r"(?<![^\x20\n])([^\x20\n]{1,40})[\x20\n]\1(?![^\x20\n])", text)))
    return [
        words, chars / n, count("[A-Z]{2,}") / n, count(r"[#*$%&<>]+") / n, count(r"\|") / n, count("!") / n, count("[0-9]+") / n,
        count("[.?]") / n, doubled / n, len(set(tokens)) / len(tokens), len(set(lines)) / len(lines), max(chars, 1.0) / len(lines),
    ]


def test_the_whole_query_is_its_numpy_form(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["quality"] is not None}
    held_out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    x = {i: statistics(t) for i, t in docs.items()}
    ids = sorted(i for i in labels if i in docs and not held_out[i])
    order = np.random.default_rng(5).permutation(len(ids))
    names = tuple(rule_ensemble.statistics(F.col("text")))
    model = rule_ensemble.fit(np.array([x[i] for i in ids])[order], np.array([float(labels[i]) for i in ids])[order], names)
    every = sorted(docs)
    margin = rule_ensemble.apply_rules(np.array([x[i] for i in every]), model.rules) @ np.array(model.weights) + model.bias
    want = dict(zip(every, 1 / (1 + np.exp(-margin)), strict=True))
    got = registry.QUERIES["op2_rule_ensemble"](spark, sf).collect()
    assert len(got) == len(docs) and model.rules
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-9)
        assert (r["held_out"], r["predicted"]) == (held_out[r["doc_id"]], int(r["score"] >= 0.5))


def test_a_repeated_id_brings_one_row_to_the_driver(spark, monkeypatch):
    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(k, f"text {k}") for k in range(8, 40)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(7, 40)], "doc_id long, quality int")
    brought = []
    kind = type(docs)
    honest = kind.toPandas

    def counted(self):
        out = honest(self)
        brought.append(len(out))
        return out

    monkeypatch.setattr(kind, "toPandas", counted)
    rule_ensemble.train(docs, labels)
    assert brought == [33]
