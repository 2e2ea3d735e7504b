"""Classes filled from tables by near names, against plain Python."""

from __future__ import annotations

from leafmill.functions.similarity import indel_ratio
from leafmill.operators import enrichment
from leafmill.plans.planning_queries import _brand_tables
from leafmill.plans.queries import QUERIES

SORTED = lambda x: " ".join(sorted(x.split()))


def column_of(columns, target):
    for c in columns:
        if c.lower().strip() == target.lower().strip():
            return c
    scored = [(indel_ratio(SORTED(target), SORTED(c)), -k, c) for k, c in enumerate(columns)]
    return max(scored)[2] if scored and max(scored)[0] >= 80 else None


def looked_up(table, target, name):
    column = column_of(table["columns"], target)
    rows = [dict(zip(table["columns"], r, strict=True)) for r in table["rows"]]
    scored = [(indel_ratio(SORTED(name), SORTED(r[column])), -k, r) for k, r in enumerate(rows) if column and r[column].split()]
    best = max(scored, key=lambda x: x[:2], default=None)
    return best[2] if best and best[0] >= 80 else None


def filled(row, tables, field, value_columns):
    table = tables.get(row["fund"])
    if row[field] not in (None, "NOT_FOUND") or not row["name"] or not table or not table["rows"]:
        return row[field]
    chain = [table["hint"] or "Share Class", *enrichment.CLASS_COLUMNS]
    found = next((r for t in chain if (r := looked_up(table, t, row["name"]))), None)
    return next((found[c] for c in value_columns if found and found.get(c)), row[field])


def test_the_query_is_plain_python(spark, sf):
    classes, tables = _brand_tables(spark, sf)
    given = {r["fund"]: r.asDict() for r in tables.collect()}
    want = sorted((r["fund"], r["ord"], r["name"], filled(r, given, "isin", enrichment.CODE_COLUMNS)) for r in classes.collect())
    got = sorted(map(tuple, QUERIES["class_codes_from_tables"](spark, sf).collect()))
    assert got == want
    assert sum(r[3].startswith("XX") for r in got) > 20


def test_odd_classes_and_tables(spark):
    classes = spark.createDataFrame(
        [("f", 1, "Class A EUR", None), ("f", 2, "EUR A Class", "kept"), ("f", 3, None, None), ("f", 4, "", "NOT_FOUND"), ("g", 5, "A", "NOT_FOUND"), (None, 6, "A", None), ("h", 7, "B acc", None), ("f", 8, "nothing like it", None)],
        "fund string, ord int, name string, fee string",
    )
    kind = "fund string, hint string, columns array<string>, rows array<array<string>>"
    tables = spark.createDataFrame(
        [("f", "Fund Name", ["Share Class ", "TER", "TER", "Annual Fee"], [["a class EUR", "1", "", "3"], ["A Class EUR", "2", "", "4"], ["", "9", "9", "9"]]),
         ("g", None, [], []), ("h", None, ["Klass", "Class"], [["B acc", "B dis"], ["x", "B  acc"]])], kind,
    )
    got = {r["ord"]: r["fee"] for r in enrichment.fill_from_tables(classes, tables, "fee", enrichment.FEE_COLUMNS).collect()}
    given = {r["fund"]: r.asDict() for r in tables.collect()}
    want = {r["ord"]: filled(r, given, "fee", enrichment.FEE_COLUMNS) for r in classes.collect()}
    assert got == want and got[1] == "4" and got[2] == "kept"
    assert enrichment.fill_from_tables(classes.limit(0), tables, "fee", enrichment.FEE_COLUMNS).count() == 0
    assert enrichment.fill_from_tables(classes, tables.limit(0), "fee", enrichment.FEE_COLUMNS).count() == 8


def test_broadcast_rows_by_funds_that_match(spark):
    classes = spark.createDataFrame([("Alpha Growth Fund", 1, "A", "NOT_FOUND"), ("Alpha Growth Fund", 2, "A", "x"), ("Beta", 1, "A", "old"), (None, 1, "A", "n")], "fund string, ord int, class string, fee string")
    rows = spark.createDataFrame(
        [("Umbrella - Alpha Growth Fund", "A", 1, "1"), ("alpha growth fnd", "A", 2, "2"), ("ALPHA GROWTH FUND", "A", 3, None), ("beta", "B", 4, "4"), ("Gamma", "A", 5, "5"), ("beta", "A", 6, "NOT_FOUND")],
        "fund string, class string, ord int, fee string",
    )
    got = {(r["fund"], r["ord"]): r["fee"] for r in enrichment.apply_rows_alike(classes, rows, ["fee"]).collect()}
    assert got == {("Alpha Growth Fund", 1): "2", ("Alpha Growth Fund", 2): "x", ("Beta", 1): "old", (None, 1): "n"}
