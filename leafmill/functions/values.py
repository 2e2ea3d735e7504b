"""Extracted values: a value with where it comes from, or why it is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.dictionaries import BENIGN_REASONS

NOT_FOUND = "NOT_FOUND"


def extracted(
    value: Column, page: Column | None = None, quote: Column | None = None, confidence: Column | float = 0.5,
    reason: Column | None = None, document: Column | None = None, source_type: Column | None = None,
) -> Column:
    """The struct of one extracted value; a null value is one that extraction failed to find."""
    missing = value.isNull() | (value == NOT_FOUND)
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    sure = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.struct(
        F.when(missing, F.lit(NOT_FOUND)).otherwise(value).alias("value"),
        (F.lit(None).cast("long") if page is None else page.cast("long")).alias("source_page"),
        text(quote).alias("source_quote"), sure.alias("confidence"),
        F.when(missing, F.coalesce(text(reason), F.lit("extraction_failed"))).alias("not_found_reason"),
        text(document).alias("external_reference"), text(source_type).alias("source_type"),
    )


def in_external_document(document: Column, quote: Column) -> Column:
    return extracted(
        F.lit(None).cast("string"), None, F.left(quote, F.lit(100)), 0.95, F.lit("in_external_doc"), document
    )


def is_not_found(variant: Column) -> Column:
    """Of a VARIANT: null, the plain mark, or a struct whose value is the mark; empty text, 0, false and [] are found."""
    plain = F.try_variant_get(variant, "$", "string")
    inner = F.try_variant_get(variant, "$.value", "string")
    return variant.isNull() | F.coalesce(F.is_variant_null(variant), F.lit(False)) | F.coalesce(F.coalesce(inner, plain) == NOT_FOUND, F.lit(False))


def raw_value(variant: Column, default: Column) -> Column:
    """The value inside a struct, one level deep, or the thing itself; nulls give the default (all as text)."""
    inner = F.coalesce(F.try_variant_get(variant, "$.value", "string"), F.try_variant_get(variant, "$", "string"))
    return F.when(variant.isNull() | F.coalesce(F.is_variant_null(variant), F.lit(False)), default).otherwise(inner)


def is_actionable(value: Column, reason: Column) -> Column:
    """Missing without a benign reason: worth another try.  A null value counts."""
    missing = value.isNull() | (value == NOT_FOUND)
    return missing & (reason.isNull() | ~reason.isin(BENIGN_REASONS))


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")
