"""What is known about each field: inventories, gaps, questions, strategies and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inventory(present: DataFrame) -> DataFrame:
    """One row a field from (field, page, confidence, table_type, ord): pages united, the last named table type."""
    named = F.nullif(F.col("table_type"), F.lit(""))
    return present.groupBy("field").agg(
        F.array_sort(F.collect_set("page")).alias("pages"), F.max("confidence").alias("confidence"),
        F.max_by(named, F.when(named.isNotNull(), F.col("ord"))).alias("table_type"), F.min("ord").alias("first_ord"),
    )


def gaps(records: DataFrame, fields: list[str], share: float = 0.8) -> DataFrame:
    """(field, n_missing, n) of fields that more than ``share`` of the records lack; one pass over the records."""
    counts = records.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(f).isNull()).alias(f) for f in fields))
    long = counts.select("n", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n_missing")) for f in fields))).alias("x"))
    return long.select("x.field", "x.n_missing", "n").where(F.col("n_missing") > share * F.col("n"))


def knowledge_stats(findings: DataFrame) -> DataFrame:
    """(doc, n_findings, n_types, n_fields, n_entities, n_open, n_urgent, fields) from findings
    (doc, type, field, entity, priority, resolved)."""
    open_ = ~F.coalesce("resolved", F.lit(False)) & F.col("priority").isNotNull()
    return findings.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_findings"), F.count_distinct("type").alias("n_types"), F.count_distinct("field").alias("n_fields"),
        F.count_distinct("entity").alias("n_entities"), F.count_if(open_).alias("n_open"),
        F.count_if(open_ & (F.col("priority") == "high")).alias("n_urgent"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"),
    )


def fill_gaps(records: DataFrame, fields: list[str], found: DataFrame) -> DataFrame:
    """Records with missing fields (null or NOT_FOUND) filled from ``found`` (field, value, ord), and ``n_filled``.

    Values that are missing or empty fill nothing; of a field's values the last counts.  Found values stay.
    """
    usable = found.where(F.col("field").isin(fields) & ~F.coalesce("value", F.lit("")).isin("", "NOT_FOUND"))
    # One row, as wide as the list of fields.
    one = usable.agg(*(F.max_by("value", F.when(F.col("field") == f, F.col("ord"))).alias(f"new_{f}") for f in fields))
    both = records.crossJoin(F.broadcast(one))
    missing = lambda f: F.col(f).isNull() | (F.col(f) == "NOT_FOUND")
    count = sum((F.when(missing(f) & F.col(f"new_{f}").isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    filled = {f: F.when(missing(f), F.coalesce(f"new_{f}", f)).otherwise(F.col(f)) for f in fields}
    return both.select(*(filled.get(c, F.col(c)).alias(c) for c in records.columns), count.cast("long").alias("n_filled"))


def questions(missing: DataFrame, n: Column) -> DataFrame:
    """(field, n_missing, priority) from counts a field: over half asks, over four fifths asks urgently."""
    asked = missing.where(F.col("n_missing") > 0.5 * n)
    return asked.withColumn("priority", F.when(F.col("n_missing") > 0.8 * n, "high").otherwise("medium"))


def suggestions(seen: DataFrame, least: int = 2) -> DataFrame:
    """(field, n_seen, first_at, example) of discovered fields seen at least twice."""
    found = seen.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_seen"), F.min("ord").alias("first_at"), F.min_by("value", "ord").alias("example")
    )
    return found.where(F.col("n_seen") >= least)


def strategies(
    asked: DataFrame, external: DataFrame, absent_said: DataFrame, absent: DataFrame, tables: DataFrame,
    pages: DataFrame, crossed: DataFrame,
) -> DataFrame:
    """(field, strategy, confidence): the first that applies of seven ways to a field, each side a table of fields."""
    steps = (
        (external, "external", 0.95), (absent_said, "explicitly_absent", 0.95), (absent, "absent", 0.8),
        (tables, "table", 0.9), (pages, "pages", 0.8), (crossed, "cross_reference", 0.85),
    )
    out = asked.select("field")
    for side, name, sure in steps:
        known = side.select("field").distinct().withColumn(f"_{name}", F.lit(True))
        out = out.join(known, "field", "left")
    pick = reduce(lambda a, s: a.when(F.col(f"_{s[1]}"), F.struct(F.lit(s[1]).alias("strategy"), F.lit(s[2]).alias("confidence"))), steps, F)
    chosen = F.coalesce(pick, F.struct(F.lit("search").alias("strategy"), F.lit(0.5).alias("confidence")))
    return out.withColumn("x", chosen).select("field", "x.strategy", "x.confidence")


def named_field(name: Column) -> Column:
    """Whether a name names a field."""
    return name.isNotNull() & ~F.lower(name).isin("null", "none", "unknown", "")


def external_references(*sources: DataFrame) -> DataFrame:
    """All references of (field, document, page, ord); the first of each (field, document) in order of source and ord."""
    both = reduce(
        lambda a, b: a.unionByName(b), (s.withColumn("source", F.lit(i)) for i, s in enumerate(sources))
    ).where(named_field(F.col("field")))
    first = Window.partitionBy("field", "document").orderBy("source", "ord")
    return both.withColumn("n", F.row_number().over(first)).where("n = 1").select("field", "document", "page", "source")
