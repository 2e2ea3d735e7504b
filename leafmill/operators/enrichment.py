"""Share classes filled from tables whose rows name them nearly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.similarity import ratio
from leafmill.functions.text import normal_name
from leafmill.operators.name_join import alike_candidates, matches
from leafmill.session import in_job, materialize, ship_code
from leafmill.sources.tables import found_columns

# The columns that rows are looked up by besides the one that is hinted at, and the columns of values.
CLASS_COLUMNS = ("Share Class", "Class")
CODE_COLUMNS = ("ISIN", "Isin", "ISIN Code")
FEE_COLUMNS = ("Management Fee", "Mgmt Fee", "Annual Fee", "TER")


def _sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda x: x != "")), " ")


def near_rows(names: DataFrame, cells: DataFrame, least: float = 80.0) -> DataFrame:
    """(doc, name, row, score): for each name the row whose cell is most like it by sorted words, the first of equal ones.

    Names (doc, name) meet the cells (doc, row, cell) of their group through a filter on the multisets of characters: a
    ratio of common subsequences cannot reach ``least`` without so many characters in common.  Empty cells name nothing.
    """
    ship_code(names.sparkSession)
    asked = names.select("doc", "name", _sorted_words(F.col("name")).alias("a")).where(F.col("a") != "").distinct()
    given = cells.select("doc", "row", _sorted_words(F.col("cell")).alias("b")).where(F.col("b") != "")
    # Of rows that spell the same, the first.
    given = materialize(given.groupBy("doc", "b").agg(F.min("row").alias("row")), "cells")
    left, right = (t.select("doc", F.col(c).alias("name")).distinct() for t, c in ((asked, "a"), (given, "b")))
    scored = alike_candidates(left, right, least / 100).withColumn("score", ratio(F.col("a"), F.col("b"))).where(F.col("score") >= least)
    best = scored.join(given, ["doc", "b"]).groupBy("doc", "a").agg(F.max_by(F.struct("row", "score"), F.struct("score", -F.col("row"))).alias("x"))
    return asked.join(best, ["doc", "a"]).select("doc", "name", "x.row", "x.score")


def fill_from_tables(classes: DataFrame, tables: DataFrame, field: str, value_columns: tuple[str, ...], least: float = 80.0) -> DataFrame:
    """Classes (fund, ord, name, and ``field``) with a missing ``field`` filled from the fund's table.

    Tables are (fund, hint, columns, rows), one a fund, ``rows`` arrays of cells along ``columns``.  The class is looked up
    in the hinted column, else in each of CLASS_COLUMNS; each is found among the headers by name or near name, and the
    first lookup that finds a row counts.  The row gives the first filled cell of ``value_columns`` (headers of that very
    name); where it has none the class stays as it is.  Values that are there, classes without a name, and funds without
    a table stay as they are; of headers that are alike the last holds the cell.
    """
    return in_job("filled", lambda: _filled(classes, tables, field, value_columns, least))


def _filled(classes: DataFrame, tables: DataFrame, field: str, value_columns: tuple[str, ...], least: float) -> DataFrame:
    missing = F.col(field).isNull() | (F.col(field) == "NOT_FOUND")
    open_ = classes.where(missing & (F.coalesce("name", F.lit("")) != "")).select("fund", "name").distinct()
    chain = F.array(F.coalesce("hint", F.lit(CLASS_COLUMNS[0])), *map(F.lit, CLASS_COLUMNS))
    asked = tables.select("fund", "columns", F.posexplode(chain).alias("place", "target"))
    heads = asked.select(F.struct("fund", "place").alias("id"), "columns", "target")
    found = found_columns(heads, least).where(F.col("column").isNotNull()).select("id.fund", "id.place", "column")
    each = tables.select("fund", "columns", F.posexplode("rows").alias("row", "cells"))
    each = materialize(each, "rows")
    last = lambda c: F.get("cells", (F.size("columns") - F.array_position(F.reverse("columns"), c)).cast("int"))
    cells = each.join(found, "fund").select(F.struct("fund", "place").alias("doc"), "row", last(F.col("column")).alias("cell")).where("cell <> ''")
    names = open_.join(found.select("fund", "place"), "fund").select(F.struct("fund", "place").alias("doc"), "name")
    met = near_rows(names, cells, least).groupBy(F.col("doc.fund").alias("fund"), "name").agg(F.min_by("row", "doc.place").alias("row"))
    value = F.coalesce(*(F.when(F.array_contains("columns", c), F.nullif(last(F.lit(c)), F.lit(""))) for c in value_columns))
    told = each.join(met, ["fund", "row"]).select("fund", "name", value.alias("_value"))
    out = classes.join(told, ["fund", "name"], "left")
    return out.withColumn(field, F.when(missing, F.coalesce("_value", field)).otherwise(F.col(field))).select(*classes.columns)


def apply_rows_alike(classes: DataFrame, rows: DataFrame, fields: list[str], least: float = 0.85) -> DataFrame:
    """Classes (fund, ord, class, fields) with found values of rows (fund, class, ord, fields) written over them.

    A row is for every fund whose name matches its own (equal, one ending with the other, or alike), and there for the
    first class of its very name; of several rows the last found value counts.
    """
    return in_job("broadcast", lambda: _applied(classes, rows, fields, least))


def _applied(classes: DataFrame, rows: DataFrame, fields: list[str], least: float) -> DataFrame:
    form = lambda df: df.select("fund", normal_name(F.col("fund")).alias("name")).distinct()
    mine, theirs = materialize(form(classes), "funds"), materialize(form(rows), "row-funds")
    one = lambda df: df.select(F.lit(0).alias("doc"), "name").distinct()
    pairs = matches(one(mine), one(theirs), least)
    pairs = pairs.join(mine.select("fund", F.col("name").alias("a")), "a").join(theirs.select(F.col("fund").alias("row_fund"), F.col("name").alias("b")), "b")
    told = rows.withColumnRenamed("fund", "row_fund").join(pairs.select("fund", "row_fund"), "row_fund")
    found = lambda f: F.col(f).isNotNull() & (F.col(f) != "NOT_FOUND")
    last = told.groupBy("fund", "class").agg(*(F.max_by(f, F.when(found(f), F.col("ord"))).alias(f"new_{f}") for f in fields))
    first = classes.groupBy("fund", "class").agg(F.min("ord").alias("ord"))
    out = classes.join(first.join(last, ["fund", "class"]), ["fund", "class", "ord"], "left")
    return out.select("fund", "ord", "class", *(F.coalesce(f"new_{f}", f).alias(f) for f in fields))
