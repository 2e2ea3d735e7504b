"""Raw tables found on pages: cleaning, stacking and alignment.

A raw table is an array of rows of cells, the first row being the header.  Reading PDF files needs a library that is not
part of this package: anything that yields (doc, page, ord, raw) rows, from a Python data source or from Parquet or JSON
files, feeds these operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.dictionaries import LOOKUP_COLUMNS
from leafmill.functions.similarity import ratio, token_sort_ratio
from leafmill.functions.text import clean_cell
from leafmill.session import materialize, ship_code


def _once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)``, where the value is found once, however often and in whatever functions ``make`` reads it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def scan(raw_tables: DataFrame) -> DataFrame:
    """(doc, page, ord, n_columns, n_rows, columns, rows, cells) of all tables that hold rows.

    Empty header cells go before cells are paired by place; rows shorter than the header or blank go.  The header is
    cleaned once, and each row then reads it.  ``cells`` are rows without the names of their columns.
    """
    clean = lambda r: F.transform(r, clean_cell)

    def held(raw: Column) -> Column:
        return _once(F.filter(F.get(raw, F.lit(0)), lambda x: x != ""), lambda columns: whole(raw, columns))

    def whole(raw: Column, columns: Column) -> Column:
        cut = F.transform(F.slice(raw, 2, F.size(raw)), lambda r: F.slice(r, 1, F.size(columns)))
        full = F.filter(cut, lambda r: (F.size(r) == F.size(columns)) & F.exists(r, lambda x: x != ""))
        return F.when(F.size(columns) > 0, F.struct(columns.alias("columns"), full.alias("cells")))

    # A table without white space and nulls is clean as it is: one search tells, instead of one a cell.
    neat = ~F.rlike(F.array_join(F.flatten("raw"), "", " "), F.lit(r"\s"))
    raw = F.when(neat, F.col("raw")).otherwise(F.transform("raw", clean))
    # A generator keeps the optimizer from putting the whole expression into every use of its parts.
    found = raw_tables.where(F.size("raw") >= 2).select("doc", "page", "ord", F.explode(F.array(_once(raw, held))).alias("t"))
    found = found.where(F.size("t.cells") > 0).select("doc", "page", "ord", "t.columns", "t.cells")
    pairs = F.transform("cells", lambda r: F.arrays_zip(F.col("columns").alias("name"), r.alias("cell")))
    return found.select(
        "doc", "page", "ord", F.size("columns").cast("long").alias("n_columns"), F.size("cells").cast("long").alias("n_rows"), "columns", pairs.alias("rows"), "cells"
    )


def last_cells(row: Column) -> Column:
    """The (name, cell) pairs of a row; of equal names the last one."""
    later = lambda i: F.slice(row["name"], i + 2, F.size(row))
    return F.filter(row, lambda x, i: ~F.array_contains(later(i), x["name"]))


def cells(tables: DataFrame) -> DataFrame:
    """(doc, page, ord, row, column, cell): one row a cell, the last of equal names, without a shuffle."""
    names = F.size("columns") != F.size(F.array_distinct("columns"))
    rows = tables.select("doc", "page", "ord", names.alias("again"), F.posexplode("rows").alias("row", "r"))
    each = rows.select("doc", "page", "ord", "row", F.explode(F.when(F.col("again"), last_cells(F.col("r"))).otherwise(F.col("r"))).alias("x"))
    return each.select("doc", "page", "ord", "row", F.col("x.name").alias("column"), F.col("x.cell").alias("cell"))


def column_map(tables: DataFrame, least: float = 80.0) -> DataFrame:
    """(doc, mapped): the columns of each document's first table, by the column names of its other tables.

    An equal name maps to itself, another to the first column most like it, from ``least`` of 100 on.  Only tables with
    other columns than the first take part, with each of their names once; two names are compared once, in however many
    documents they meet.
    """
    ship_code(tables.sparkSession)
    first = tables.groupBy("doc").agg(F.min_by("columns", F.struct("page", "ord")).alias("canonical"))
    other = tables.select("doc", "columns").distinct().join(first, "doc").where(F.col("columns") != F.col("canonical"))
    names = other.select("doc", "canonical", F.explode("columns").alias("column")).distinct()
    equal = F.array_contains("canonical", F.col("column"))
    pairs = names.select("doc", "column", equal.alias("equal"), F.posexplode("canonical").alias("place", "name"))
    pairs = pairs.where(~F.col("equal") | (F.col("column") == F.col("name")))
    asked = pairs.where(~F.col("equal")).select("column", "name").distinct()
    near = asked.withColumn("near", ratio(F.col("column"), F.col("name")))  # a filter here would move before distinct
    alike = F.when(F.col("equal"), 100.0).otherwise(F.col("near"))
    best = pairs.join(near, ["column", "name"], "left").withColumn("alike", alike).where(F.col("alike") >= least)
    best = best.groupBy("doc", "column").agg(F.max_by("name", F.struct("alike", -F.col("place"))).alias("name"))
    return best.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("column", "name"))).alias("mapped"))


def stitched(tables: DataFrame, pages: DataFrame | None = None, least: float = 80.0) -> DataFrame:
    """Tables of the listed pages (doc, page), or of all pages, as one a document: (doc, columns, rows, n_rows).

    Columns are those of the first table.  Rows of tables with the same columns stay; of others, cells go under the
    column that theirs maps to (:func:`column_map`), the last of those that meet, and cells and rows without one go.
    Rows hold a cell a column, in the order of columns, as :func:`scan` makes them; so the places of the cells that stay
    are found once a table.
    """
    some = tables if pages is None else tables.join(pages.select("doc", "page").distinct(), ["doc", "page"], "left_semi")
    cells = F.col("cells") if "cells" in tables.columns else F.transform("rows", lambda r: r["cell"])
    some = materialize(some.select("doc", "page", "ord", "columns", cells.alias("cells")), "tables")  # read four times, parsed once
    first = some.groupBy("doc").agg(F.min_by("columns", F.struct("page", "ord")).alias("canonical"))
    told = some.join(first, "doc").join(column_map(some, least), "doc", "left")
    same = F.col("columns") == F.col("canonical")

    def last(names: Column) -> Column:
        """Names with their places, the last place of equal ones."""
        places = F.transform(names, lambda x, i: F.struct(x.alias("name"), i.alias("place")))
        again = lambda x: F.array_contains(F.filter(F.slice(names, x["place"] + 2, F.size(names)), F.isnotnull), x["name"])
        return F.filter(places, lambda x: x["name"].isNotNull() & ~again(x))

    def moved(kept: Column) -> Column:
        cells = F.transform("cells", lambda r: F.transform(kept["place"], lambda i: F.get(r, i)))
        return F.when(F.size(kept) > 0, F.struct(kept["name"].alias("names"), cells.alias("cells")))

    names = F.transform("columns", lambda c: F.try_element_at("mapped", c))
    other = F.when(F.col("mapped").isNotNull(), _once(_once(names, last), moved))
    held = told.withColumn("t", F.when(same, F.struct(F.col("columns").alias("names"), "cells")).otherwise(other))
    held = held.groupBy("doc").agg(
        F.first("canonical").alias("columns"), F.sort_array(F.collect_list(F.struct("page", "ord", "t.names", "t.cells"))).alias("t")
    )
    pairs = lambda x: F.transform(x["cells"], lambda r: F.arrays_zip(x["names"].alias("name"), r.alias("cell")))
    held = held.select("doc", "columns", F.filter("t", lambda x: x["cells"].isNotNull()).alias("t"))
    n_rows = F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + F.size(x["cells"]))
    return held.select("doc", "columns", F.flatten(F.transform("t", pairs)).alias("rows"), n_rows.alias("n_rows"))


def found_columns(tables: DataFrame, least: float = 80.0) -> DataFrame:
    """(id, target, column) of (id, columns, target): the first column equal to the target but for case and space around,
    else the first most like it by sorted words, from ``least`` of 100 on, else null."""
    ship_code(tables.sparkSession)
    each = tables.select("id", "target", F.posexplode("columns").alias("place", "column"))
    equal = F.lower(F.trim("column")) == F.lower(F.trim("target"))
    alike = F.when(equal, 1000.0).otherwise(token_sort_ratio(F.col("target"), F.col("column")))
    best = each.withColumn("alike", alike).where(F.col("alike") >= least).groupBy("id", "target").agg(
        F.max_by("column", F.struct("alike", -F.col("place"))).alias("column")
    )
    return tables.select("id", "target").distinct().join(best, ["id", "target"], "left")


def lookup_column(columns: Column) -> Column:
    """The column by which rows are looked up: the first header of the usual ones, else the first column."""

    def named(name: str) -> Column:
        return F.get(F.filter(columns, lambda c: F.lower(c) == name), F.lit(0))

    usual = [named(name) for name in LOOKUP_COLUMNS]
    return F.coalesce(*usual, F.get(columns, F.lit(0)))


def render(pages: DataFrame) -> DataFrame:
    """(doc, text): pages in order under headers, with a blank line between."""
    told = F.concat(F.lit("=== PAGE "), F.col("page").cast("string"), F.lit(" ===\n"), F.coalesce("text", F.lit("")))
    held = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", told.alias("text")))).alias("p"))
    return held.select("doc", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def per_document(df: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows of each document."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy(order))
    return df.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")
