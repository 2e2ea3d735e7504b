"""The pipeline against a plain version, stage by stage and as a whole."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from leafmill.llm import bpe
from test_llm_operators import KINDS, WORD, brute_similar, brute_stats, brute_targets


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def test_rules_reject(stages):
    before, after = stages[0].collect(), stages[1].collect()
    kept = {r["doc_id"] for r in after}
    for r in before:
        words, chars, symbols, _, repeats = brute_stats(r["text"])
        text = r["text"]
        lines = [x for x in text.split("\n") if WORD.search(x)]
        later = len(lines) - len(set(lines))
        found = WORD.findall(text)
        doubled = sum(a == b for a, b in zip(found, found[1:]))
        letters = sum(c.isascii() and c.isalpha() for c in text)
        upper = sum(c.isascii() and c.isupper() for c in text)
        bad = (
            words < 20 or 100 * repeats > 30 * words or 10 * symbols > 3 * words or chars < 2 * words or chars > 16 * words
            or 2 * upper > letters or (later >= 3 and 2 * later > len(lines)) or 10 * doubled > 3 * words
        )
        assert (r["doc_id"] in kept) != bad
    assert stages[1].columns == stages[0].columns


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    expected = sorted({c for _, _, c in brute_similar(rows, 5, 80)})
    assert sorted(r["doc_id"] for r in stages[2].collect()) == expected


def test_secrets_go(stages):
    before = {r["doc_id"]: r for r in stages[2].collect()}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    owners, held = {}, {}
    for i, r in before.items():
        for _, pattern, group, least in KINDS:
            for m in pattern.finditer(r["text"]):
                if len(m[group]) >= least:
                    owners.setdefault(m[group], set()).add(r["source"])
                    held.setdefault(i, []).append(m[group])
    live = {i for i, values in held.items() if any(len(owners[v]) <= 2 for v in values)}
    assert {i for i in before if before[i]["text"] != after[i]["text"]} == live
    assert all("[secret]" in after[i]["text"] for i in live)
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_mixture_and_tokens(stages):
    sizes, taken = Counter(), Counter()
    for r in stages[3].collect():
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in stages[4].collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
    target = brute_targets(sizes)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.1 * target[s], 100)
    assert max(Counter(r["doc_id"] for r in stages[4].collect()).values()) <= 3
    library = Tokenizer.from_file(bpe.vocabulary_path())
    texts = Counter((r["doc_id"], r["text"]) for r in stages[4].collect())
    expected = Counter()
    for (i, t), n in texts.items():
        expected[i, np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()] += n
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in stages[5].collect()) == expected


def test_run_is_the_stages(spark, sf, stages):
    got = Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == Counter((r["doc_id"], r["n_tokens"]) for r in stages[5].collect())


def test_stages_on_odd_rows_and_empty_tables(spark, sf):
    fine = " ".join(f"word{k} and{k}" for k in range(40)) + "."
    long = " ".join(f"w{k}x" for k in range(60_000)) + " password=longsecret77"
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n ", "en", None, 3), (4, fine, "en", "a", 1), (5, fine, "en", "b", 1),
        (5, fine, "en", "b", 1), (None, fine + " more words", None, None, None), (None, long, "en", "c", 9), (6, long[::-1], "en", "c", 9),
        (7, "x" * 50_000, "en", "c", 1), (8, fine.replace("and", "or"), "en", "a", 2), (8, fine.replace("and", "nor"), "fr", "a", 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for part in (docs, docs.limit(0)):
        step = part
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, sf).cache()
            assert step.columns == docs.columns
            kept.append(step.count())
        out = corpus_pipeline.STAGES[-1][1](spark, step, sf)
        assert out.count() == step.count()
    # Wordless and short texts go; of the three equal texts and the one with two words more one stays.
    assert kept[:3] == [8, 5, 5] and kept[4:] == [0, 0, 0, 0]
