"""References from one part of a document to another, or to other documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import dictionaries as d
from leafmill.functions.text import any_of, first_of


def table_field(kind: Column) -> Column:
    """The field that a table's type speaks of, or null."""
    return first_of(F.lower(kind), d.TABLE_FIELDS)


def classified(references: DataFrame) -> DataFrame:
    """References (text, is_external, field_hint, external_doc, source_page, target_page, ...) told apart.

    Adds ``external``: marked so, or by its words.  External ones get ``field`` (their hint, else by words, else
    ``unknown``) and ``document`` (named, else by words); all others ``page`` (the target, else the source).  References
    without text go.
    """
    low = F.lower("text")
    external = F.coalesce(F.col("is_external"), F.lit(False)) | any_of(low, d.EXTERNAL_WORDS)
    told = references.where(F.coalesce(F.col("text"), F.lit("")) != "").withColumn("external", external)
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    field = F.coalesce(filled("field_hint"), first_of(low, d.REFERENCE_FIELDS), F.lit("unknown"))
    document = F.coalesce(filled("external_doc"), first_of(low, d.EXTERNAL_NAMES), F.lit("External Document"))
    return told.withColumns({
        "field": F.when(F.col("external"), field), "document": F.when(F.col("external"), document),
        "page": F.when(~F.col("external"), F.coalesce(F.nullif(F.col("target_page"), F.lit(0)), F.col("source_page"))),
    })


def attributed(references: DataFrame, page_index: DataFrame) -> DataFrame:
    """Relations (type, subject, object, text, page, source_page) from funds to the sections that their pages refer to.

    The fund of a reference is the first named one of its page in ``page_index`` (doc, page, fund, ord); references that
    are marked external, and those of pages without a fund, give none.
    """
    named = page_index.where(F.coalesce(F.col("fund"), F.lit("")) != "")
    first = named.groupBy("doc", F.col("page").alias("source_page")).agg(F.min_by("fund", "ord").alias("fund"))
    inner = references.where((F.coalesce(F.col("text"), F.lit("")) != "") & ~F.coalesce(F.col("is_external"), F.lit(False)))
    return inner.join(first, ["doc", "source_page"]).select(
        F.lit("references").alias("type"), F.concat(F.lit("fund:"), F.col("fund")).alias("subject"),
        F.concat(F.lit("section:"), F.coalesce(F.nullif(F.col("target"), F.lit("")), F.lit("unknown"))).alias("object"),
        "text", F.nullif(F.col("target_page"), F.lit(0)).alias("page"), "source_page",
    )
