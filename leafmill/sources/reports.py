"""Sinks: JSON documents and HTML reports, one row a document, written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.assembly import escaped, fragment

STYLE = ".high{color:#060}.medium{color:#960}.low{color:#900}"


def write_json(documents: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out."""
    documents.write.json(path)


def read_json(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def html_reports(values: DataFrame) -> DataFrame:
    """(doc, html) from (doc, fund, field, value, confidence, quote): a section a fund, a row a field, in order."""
    row = F.concat(F.lit("<tr><td>"), escaped(F.col("field")), F.lit("</td><td>"), fragment(F.col("value"), F.col("confidence"), F.col("quote")), F.lit("</td></tr>"))
    funds = values.groupBy("doc", "fund").agg(F.array_sort(F.collect_list(F.struct("field", row.alias("h")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: x["h"]), "")
    funds = funds.select("doc", "fund", F.concat(F.lit("<section><h2>"), escaped(F.col("fund")), F.lit("</h2><table>"), body, F.lit("</table></section>")).alias("h"))
    docs = funds.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("fund", "h"))).alias("s"))
    whole = F.concat(
        F.lit(f"<!DOCTYPE html><html><head><style>{STYLE}</style></head><body>"), F.array_join(F.transform("s", lambda x: x["h"]), ""), F.lit("</body></html>")
    )
    return docs.select("doc", whole.alias("html"))


def find_funds(funds: DataFrame, text: str) -> DataFrame:
    """Funds whose name holds the text in any case."""
    return funds.where(F.contains(F.lower("fund"), F.lit(text.lower())))
