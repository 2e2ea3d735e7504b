"""URL filters: rules, parts of urls and exact membership, against plain Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from leafmill.llm import url_filter as u

URLS = [
    "http://A.example.net/en/1?x=/de/", "https://example.net/en/", "https://example.net/enough", "http://net/", "http://net",
    "http://notnet/", "http://example.com/de/#a", "http://www.example.com/fr/", "http://x.org/fr/a", "http://org?/fr/", "x",
    "", None, "://", "a://b://c/d", "http://m.spam-farm.example.org/en/1", "http://spam-farm.example.org/fr/1",
    "http://spam-farm.example.organic/", "http://user@Host:80/p#q?r", "line\nhttp://Ü.NET/en/\nx",
]


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    below = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h + p), h + p, v) for v, h, p in u.RULES if below(h) and path.startswith(p)]
    rule, verdict = max(fits)[1:] if fits else (None, "block" if any(map(below, u.LISTED)) else "allow")
    return host, path, rule, verdict


def test_judged_as_plain_python(spark):
    rows = [(i, x, "own") for i, x in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judge(pages).collect()}
    assert got == {i: plain(x) for i, x, _ in rows}
    assert u.judge(pages).columns == ["page_id", "url", "key", "host", "path", "verdict", "rule"]


def test_no_rules_no_names_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert u.judge(pages, (), ()).first()["verdict"] == "allow"
    assert u.judge(pages.limit(0)).count() == 0
    assert u.judge(pages.where("url is null").unionByName(pages.select("page_id", F.lit(None).cast("string").alias("url")))).first()["host"] == ""


@pytest.mark.parametrize("share", [0, 1, 10, 100])
@pytest.mark.parametrize("most_words", [1 << 21, 40])
def test_membership_is_exact_for_every_key(spark, share, most_words):
    keys = spark.range(1500).select(F.concat(F.lit("k"), (F.col("id") % 1200)).alias("key"), F.lit("x").alias("own"))
    keys = keys.unionByName(spark.createDataFrame([(None, "x")], "key string, own string"))
    # Listed keys that no row has, repeated ones and a null change nothing.
    listed = spark.range(1300).where((F.col("id") * 37 % 100 < share) | F.col("id").between(1201, 1300)).select(F.concat(F.lit("k"), "id").alias("x"))
    listed = listed.unionByName(listed).unionByName(spark.createDataFrame([(None,)], "x string"))
    got = u.membership(keys, "key", listed, bits_a_key=4, most_words=most_words).collect()
    assert len(got) == 1501
    for r in got:
        assert r["listed"] == (r["key"] is not None and int(r["key"][1:]) * 37 % 100 < share)


def test_later_filters_are_needed_and_smaller(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 10 == 0).alias("listed"))
    cascade = u.build(universe, bits_a_key=4)
    words = [w for _, w, _ in cascade.levels]
    assert len(words) > 3 and words[-1] < words[0]
    wrong = universe.where(cascade.holds(F.col("key")) != F.col("listed"))
    assert wrong.count() == 0
    first = universe.where(cascade.knows(F.col("key"), 0) & ~F.col("listed"))
    assert first.count() > 0


def test_rows_meet_no_join_and_no_python(spark, sf):
    pages = u.read_table(spark, sf, "pages")
    plan = u.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
