"""Many terms in one scan, and search to the fixpoint, against plain Python."""

from __future__ import annotations

import random
import re

import pytest

from leafmill.operators import learning

CODE = r"([A-Z]{2}[A-Z0-9]{10})"


@pytest.mark.parametrize("most", [100_000, 700])
def test_ten_thousand_terms(spark, most):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(10_000)]
    terms = list(dict.fromkeys(words)) + ["", "🙂", "dup", "dup"]
    texts = [" ".join(rng.choices(words, k=5)).upper() for _ in range(60)] + ["", None, "🙂 DUP", "zzz"]
    pages = spark.createDataFrame([(k if k != 5 else None, x, "own") for k, x in enumerate(texts)], "page long, text string, term string")
    df = learning.term_hits(pages, terms, most=most)
    got = {(r["page"], terms[r["term"]]) for r in df.collect()}
    assert got == {(k if k != 5 else None, x) for k, t in enumerate(texts) for x in terms if x and t and x in t.lower()}
    assert df.count() == len(got)
    if most > len(terms):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        one = learning.term_hits(pages, terms, first=True).collect()
        assert len(one) == len({p for p, _ in got}) and {(r["page"], terms[r["term"]]) for r in one} <= got


def plain(texts, seeds):
    terms, found = set(seeds), {}
    fresh, number, rounds = set(seeds), 0, dict.fromkeys(seeds, 0)
    while fresh:
        hit = {k for k, t in texts.items() if k not in found and t and any(x in t.lower() for x in fresh)}
        found |= dict.fromkeys(hit, number)
        fresh = {c[:3].lower() for k in hit for c in re.findall(CODE, texts[k])} - terms
        terms |= fresh
        number += 1
        rounds |= dict.fromkeys(fresh, number)
    return found, rounds


def test_rounds_until_nothing_is_new(spark):
    chain = [f"x{k} {chr(65 + k)}{chr(65 + k)}{k}000000000 {chr(66 + k)}{chr(66 + k)}{k + 1}000000000" for k in range(8)]
    texts = dict(enumerate([*chain, "seed aa0", "nothing", None, "", "bb1 too", "ZZ9000000000"]))
    pages = spark.createDataFrame(list(texts.items()), "page int, text string")
    found, terms = learning.learned_search(pages, ["Seed", ""], CODE)
    want, learned = plain(texts, ["seed"])
    assert {r["page"]: r["round"] for r in found.collect()} == want
    assert {r["term"]: r["round"] for r in terms.collect()} == learned
    found, terms = learning.learned_search(pages, ["bb1"], CODE)
    want, learned = plain(texts, ["bb1"])
    assert {r["page"]: r["round"] for r in found.collect()} == want and max(want.values()) > 3
    assert {r["term"]: r["round"] for r in terms.collect()} == learned
    found, terms = learning.learned_search(pages.limit(0), ["a"], CODE)
    assert found.count() == 0 and terms.count() == 1
    assert learning.learned_search(pages, [], CODE)[0].count() == 0
