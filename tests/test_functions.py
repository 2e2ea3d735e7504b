"""Small cases of the column functions, against plain Python where SQL has no form."""

from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.operators import constraints
from leafmill.functions import text as t
from leafmill.functions.similarity import common_subsequence, indel_ratio, matcher_ratio, token_sort_ratio
from leafmill.functions.values import extracted, is_actionable, is_not_found, raw_value
from leafmill.operators import assembly, graph, passes, planning, resolve, structure


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (t.percentage, {"max 10%": 10.0, "5.5 percent": 5.5, "none": None, "1,000%": 0.0, None: None}),
        (t.hedge_ratio, {"Fully hedged": 100.0, "95 %": 95.0, "no": None}),
        (t.days, {"30 days": 30, "30-day": None, "one month": 30, "1 year": 365, "none": None}),
        (t.comparator, {"max 5": "max", "at least 3": "min", "5": None}),
        (t.restriction, {"single issuer": "concentration_limit", "EU bonds": "geographic_limit", "bonds": "asset_limit", "x": "asset_limit"}),
        (t.normal_name, {" A - B-c ": "a b c", "X — Y": "x y", "": ""}),
        (t.clean_cell, {" a \n b ": "a b", None: ""}),
        (lambda c: t.amount(c)[0], {"EUR 5,000": 5000.0, "5000 USD": 5000.0, "$1,000.50": 1000.5, "EUR ,": None, "x": None}),
        (lambda c: t.amount(c)[1], {"EUR 5,000": "EUR", "5000 USD": "USD", "$1": "USD", "x": None}),
    ],
)
def test_parsers(spark, make, cases):
    assert column(spark, list(cases), make) == list(cases.values())


def test_restrictions(spark):
    rows = spark.createDataFrame([(1, "max 10% single issuer; ; 0% cash"), (2, None), (3, "")], "id int, text string")
    got = constraints.restrictions(rows, "text", ["id"]).orderBy("id", "pos").collect()
    assert [(x["id"], x["pos"], x["type"], x["value"], x["unit"], x["comparator"]) for x in got] == [
        (1, 0, "concentration_limit", 10.0, "percent", "max"), (1, 1, "asset_limit", 0.0, None, None),
    ]


def test_constraints_of_funds_and_classes(spark):
    funds = spark.createDataFrame(
        [(1, None, "VaR max 20%", "hedging only"), (2, "NOT_FOUND", "gross exposure", "up to 5 % each"), (3, "eu bonds", None, "a limit")],
        "id int, restrictions string, leverage string, derivatives string",
    )
    got = {(r["id"], r["type"], r["value"], r["unit"], r["comparator"]) for r in constraints.of_funds(funds).collect()}
    assert got == {
        (1, "var_limit", 20.0, "percent", "max"), (1, "derivative_policy", None, None, None), (2, "leverage_limit", None, None, None),
        (2, "derivative_limit", 5.0, "percent", "max"), (3, "geographic_limit", None, None, None), (3, "derivative_limit", None, None, None),
    }
    classes = spark.createDataFrame(
        [(1, False, "80%", "all", "EUR 5", "30 days"), (2, True, None, None, "much", "soon"), (3, None, "fully hedged", "NOT_FOUND", None, None), (4, None, None, None, None, None)],
        "id int, hedged boolean, hedging string, investors string, minimum string, holding string",
    )
    got = {(r["id"], r["type"], r["value"], r["unit"], r["comparator"]) for r in constraints.of_classes(classes).collect()}
    assert got == {
        (1, "investor_eligibility", None, None, None), (1, "minimum_investment", 5.0, "EUR", "min"), (1, "holding_period", 30.0, "days", "min"),
        (2, "hedging_policy", None, None, None), (2, "minimum_investment", None, "currency", None), (2, "holding_period", None, None, None),
        (3, "hedging_policy", 100.0, "percent", "exact"),
    }


def test_missing_states(spark):
    cases = ["null", '"NOT_FOUND"', '{"value":"NOT_FOUND"}', '""', "0", "false", "[]", '{"value":"x"}', None]
    assert column(spark, cases, lambda c: is_not_found(F.try_parse_json(c))) == [True, True, True] + [False] * 5 + [True]
    raw = column(spark, cases, lambda c: raw_value(F.try_parse_json(c), F.lit("-")))
    assert raw[0] == "-" and raw[7] == "x" and raw[8] == "-"
    ev = column(spark, ["a", "NOT_FOUND", None], lambda c: extracted(c))
    assert [e["not_found_reason"] for e in ev] == [None, "extraction_failed", "extraction_failed"]
    assert column(spark, ["a", "NOT_FOUND", None], lambda c: is_actionable(c, F.lit("not_applicable"))) == [False] * 3


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abcé ", max_size=40), st.text("abcé ", max_size=40))
def test_common_subsequence(a, b):
    assert common_subsequence(a, b) == _lcs(a, b)


def test_similarity(spark):
    df = spark.createDataFrame([("new york", "york new"), ("abc", "abd"), (None, "a"), ("", "")], "a string, b string")
    rows = df.select(matcher_ratio("a", "b").alias("m"), token_sort_ratio(F.col("a"), F.col("b")).alias("s")).collect()
    assert rows[0]["s"] == 100 and rows[1]["s"] == pytest.approx(indel_ratio("abc", "abd"))
    assert rows[1]["m"] == pytest.approx(SequenceMatcher(None, "abc", "abd").ratio())
    assert rows[2]["m"] is None and rows[3]["m"] == 1.0


def test_greedy_clusters_depend_on_order(spark):
    rows = [(1, "Alpha Growth", 1), (1, "Alpha  growth", 2), (1, "Umbrella - Alpha Growth", 3), (1, "Beta", 4), (2, "Beta", 1)]
    got = resolve.greedy_clusters(spark.createDataFrame(rows, "doc int, name string, ord int")).collect()
    assert {(r["doc"], r["name"]): r["canonical"] for r in got} == {
        (1, "Alpha Growth"): "Alpha Growth", (1, "Alpha  growth"): "Alpha Growth",
        (1, "Umbrella - Alpha Growth"): "Alpha Growth", (1, "Beta"): "Beta", (2, "Beta"): "Beta",
    }


def test_fold_compares_doubles(spark):
    rows = [("k", "f", 1, "a", 0.6, 1, "table"), ("k", "f", 2, "b", 0.9, 1, "unknown"), ("k", "f", 3, "c", 0.9, 5, "table")]
    df = spark.createDataFrame(rows, "key string, field string, ord int, value string, confidence double, page long, source string")
    r = resolve.fold_facts(df).first()
    # 0.9 - 0.6 is just above 0.3 in doubles, so the first conflict is settled by confidence.
    assert (r["value"], r["n_conflicts"], r["by_confidence"], r["by_default"]) == ("c", 2, 1, 1)


def test_chunks_and_runs(spark):
    docs = spark.createDataFrame([(1, 100), (2, 0), (3, 31)], "doc int, n_pages long")
    got = sorted((r["doc"], r["page_start"], r["page_end"]) for r in structure.fixed_chunks(docs, F.lit(30)).collect())
    assert got == [(1, 1, 30), (1, 31, 60), (1, 61, 90), (1, 91, 100), (3, 1, 30), (3, 31, 31)]
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 2, 3, 7, 9, 10)], "doc int, page long")
    runs = [(r["page_start"], r["page_end"]) for r in structure.runs(pages, "doc").orderBy("run").collect()]
    assert runs == [(1, 3), (7, 7), (9, 10)]
    assert list(structure.chunk_ends(50, [1, 12, 35, 51], 10, 30)) == [(1, 11), (12, 34), (35, 50)]


def test_overlaps_match_nested_loops(spark):
    left = [(i, a, a + w) for i, (a, w) in enumerate([(1, 0), (5, 200), (64, 1), (63, 2), (128, 0)])]
    right = [(i, a, a + w) for i, (a, w) in enumerate([(1, 300), (64, 0), (65, 63), (129, 5)])]
    a = spark.createDataFrame(left, "l int, l_start long, l_end long")
    b = spark.createDataFrame(right, "r int, r_start long, r_end long")
    got = sorted((x["l"], x["r"]) for x in structure.overlapping(a, b).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if x[1] <= y[2] and y[1] <= x[2])


def test_graph_paths(spark):
    rel = spark.createDataFrame([("t", 1, 2, 0.5, "a", 1), ("t", 1, 2, 0.9, "b", 2)], "type string, subject int, object int, confidence double, property string, ord int")
    assert graph.merge_relations(rel).first()["confidence"] == 0.9
    assert graph.first_relations(rel).first()["confidence"] == 0.5
    assert column(spark, ["x", "table:1"], graph.keyed) == ["fund:x", "table:1"]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_tables_link_the_funds_known_so_far(spark, width):
    funds = spark.createDataFrame([("d", 1, "fund:a"), ("d", 4, "fund:b"), ("d", 9, "fund:a"), (None, 1, "fund:n"), ("e", 2, "fund:c"), ("d", 4, "fund:t")], "doc string, ord int, key string")
    rows = [("d", 3, "isin", [7], True, None), ("d", 4, "fee", [8, 9], True, "x"), ("d", 5, "isin", [7], True, None), ("d", 2, "isin", [1], False, "z"),
            ("d", 9, "fee", [2], False, None), ("d", 9, "fee", [], True, None), (None, 5, "fee", [1], True, None), ("e", 1, "fee", [1], True, None)]
    notes = spark.createDataFrame(rows, "doc string, ord int, kind string, pages array<int>, consolidated boolean, fund string")
    got = graph.table_links(funds, graph.recorded_tables(notes), width).collect()
    assert sorted(tuple(r)[1:] for r in got if r["doc"] == "d") == [
        ("has_fee_in", "fund:a", "table:fee_8", 4), ("has_isin_in", "fund:a", "table:isin_7", 3), ("has_isin_in", "fund:b", "table:isin_7", 5),
        ("has_isin_in", "fund:t", "table:isin_7", 5), ("has_isin_in", "fund:z", "table:isin_1", 2),
    ]
    assert {r["doc"] for r in got} <= {"d"}


def test_nested_sections(spark):
    rows = [("d", 1, 1, "A", 1), ("d", 2, 2, "A.1", 2), ("d", 3, 4, "A.1.x", 2), ("d", 4, 3, "A.1.y", 5), ("d", 5, 2, "A.2", 5), ("d", 6, 1, "B", 9), (None, 1, None, "N", 3), ("e", 1, 3, "deep", 4)]
    frame = spark.createDataFrame([(*r, 20, "x") for r in rows], "doc string, ord int, level int, title string, page int, last_page int, depth string").repartition(3)
    got = {(r["doc"], r["title"]): (r["page"], r["page_end"], r["parent"], r["depth"]) for r in structure.nested_sections(frame).collect()}
    assert got == {
        ("d", "A"): (1, 8, None, 1), ("d", "A.1"): (2, 4, 1, 2), ("d", "A.1.x"): (2, 4, 2, 3), ("d", "A.1.y"): (5, 5, 2, 3), ("d", "A.2"): (5, 8, 1, 2),
        ("d", "B"): (9, 20, None, 1), (None, "N"): (3, 20, None, 1), ("e", "deep"): (4, 20, None, 1),
    }
    assert structure.nested_sections(frame.limit(0)).count() == 0
    chain = spark.range(3000).select(F.lit(1).alias("doc"), "id", F.col("id").alias("ord"), F.col("id").alias("level"), F.lit("t").alias("title"), F.col("id").alias("page"), F.lit(3000).alias("last_page"))
    assert structure.nested_sections(chain).agg(F.max("depth")).first()[0] == 3000


@pytest.mark.parametrize(
    ("planned", "noted", "n", "want"),
    [
        ([3, 1, 9], [50], 100, [1, 3, 9]), (list(range(1, 32)), [4, 2, 4], 200, [2, 4]), (list(range(1, 10)), None, 10, list(range(1, 11))),
        ([1, 90], [], 100, [*range(1, 6), *range(86, 101)]), (None, list(range(40, 0, -1)), 99, [*range(1, 6), *range(16, 41)]), ([], [], 7, list(range(1, 8))),
        (list(range(1, 31)), [5], 261, list(range(1, 31))), (None, None, 0, []), ([1, 80], [5], 100, [1, 80]), ([1, 81], [5], 100, [5]),
    ],
)
def test_umbrella_pages(spark, planned, noted, n, want):
    row = spark.createDataFrame([(planned, noted, n)], "p array<int>, q array<int>, n int")
    assert row.select(planning.umbrella_pages(F.col("p"), F.col("q"), F.col("n"))).first()[0] == want


def test_fragment_is_escaped(spark):
    got = column(spark, ["<a&'\">"], lambda c: assembly.fragment(c, F.lit(0.5), c))[0]
    assert got == '<span class="medium" title="&lt;a&amp;&#x27;&quot;&gt;">&lt;a&amp;&#x27;&quot;&gt;</span>'


def test_section_chunks_cover_every_page_once():
    got = list(passes.section_chunks([(1, 20), (21, 45), (46, 120), (130, 140)], 150))
    assert got == [
        (1, 45, "complete"), (46, 75, "partial_section"), (76, 105, "partial_section"), (106, 120, "partial_section"),
        (121, 129, "gap"), (130, 140, "complete"), (141, 150, "gap"),
    ]
    assert list(passes.section_chunks([], 65)) == [(1, 30, "naive"), (31, 60, "naive"), (61, 65, "naive")]


def test_whole_numbers_are_those_that_a_cast_reads(spark):
    odd = ["5", " 7 ", "+3", "-12", "\t8\n", "", " ", "+", "-", "--1", "1 2", "1-", "12.5", "1.", ".5", "1e3", "N", "a1", "0x1", "1_0", "٣", "９", "é1", "1,000"]
    odd += ["9223372036854775807", "9223372036854775808", "-9223372036854775808", "007", "5 ", " 5", "5\x00", "\x7f5", "$5", "5L", "Infinity", None]
    assert column(spark, odd, t.whole_number) == column(spark, odd, lambda c: c.try_cast("long"))
