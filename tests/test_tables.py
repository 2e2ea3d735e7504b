"""Raw tables put together: small cases that SQL over the given tables doesn't reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.sources import tables

RAW = "doc int, page int, ord int, raw array<array<string>>"


def together(spark, rows, *pages):
    found = tables.scan(spark.createDataFrame(rows, RAW))
    out = tables.stitched(found, *(spark.createDataFrame(p, "doc int, page int") for p in pages)).collect()
    return {r["doc"]: (r["columns"], [[tuple(x) for x in row] for row in r["rows"]], r["n_rows"]) for r in out}


def test_all_pages_without_a_list_of_them(spark):
    rows = [(1, 2, 0, [["Quanttity", "Flag"], ["3", "x"]]), (1, 1, 0, [["Quantity", "Flag"], ["1", "a"], ["2", "b"]])]
    whole = together(spark, rows)
    stacked = [[("Quantity", q), ("Flag", f)] for q, f in (("1", "a"), ("2", "b"), ("3", "x"))]
    assert whole == {1: (["Quantity", "Flag"], stacked, 3)} == together(spark, rows, [(1, 1), (1, 2)])
    assert together(spark, rows, [(1, 2)]) == {1: (["Quanttity", "Flag"], [[("Quanttity", "3"), ("Flag", "x")]], 1)}


def test_last_of_cells_that_meet_and_tables_without_any(spark):
    rows = [
        (1, 1, 0, [["Quantity", "Flag", "Flag"], ["1", "a", "b"]]), (1, 2, 0, [["Quantiti", "Other", "Quantity", "Flag"], ["7", "o", "8", "c"], ["9", "o", "", "d"]]),
        (1, 3, 0, [["Nothing"], ["z"]]), (2, 1, 0, [["", "Only"], ["x"], ["", ""], [" y "]]), (3, 1, 0, [["", " "], ["x", "y"]]), (3, 2, 0, [["Late"], ["1", "2"], ["3"]]),
    ]
    assert together(spark, rows) == {
        1: (["Quantity", "Flag", "Flag"], [[("Quantity", "1"), ("Flag", "a"), ("Flag", "b")], [("Quantity", "8"), ("Flag", "c")], [("Quantity", ""), ("Flag", "d")]], 3),
        2: (["Only"], [[("Only", "x")], [("Only", "y")]], 2),
        3: (["Late"], [[("Late", "1")], [("Late", "3")]], 2),
    }


def test_two_names_are_compared_once(spark, monkeypatch):
    """However many documents hold the same two headers, a pair of names is a row of the comparison once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(a, b):
        seen.add(1)
        return 90.0

    monkeypatch.setattr(tables, "ratio", counted)
    rows = [(d, p, 0, [["Quantity" if p else "Quanttity"], ["1"]]) for d in range(200) for p in (0, 1)]
    held = tables.scan(spark.createDataFrame(rows, RAW))
    assert len(tables.column_map(held).collect()) == 200
    assert seen.value <= 4
