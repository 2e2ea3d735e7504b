"""Queries over raw tables, rendered pages, replayed answers and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.session import read_table
from leafmill.sources import models, reports, tables


def _raw(spark, sf):
    """Line items as raw tables, one an order: an unnamed and a repeated column, a blank row (6) and a short one (7)."""
    l = read_table(spark, sf, "lineitem")
    s = lambda *cells: F.array(*cells)
    quantity = F.concat(F.lit("  "), F.col("l_quantity").cast("int").cast("string"), F.lit("\n"))
    row = (
        F.when(F.col("l_linenumber") == 6, s(*map(F.lit, ("", " ", "\n", ""))))
        .when(F.col("l_linenumber") == 7, s(quantity, F.col("l_returnflag")))
        .otherwise(s(quantity, F.col("l_returnflag"), F.concat("l_linestatus", F.lit("  x")), F.lit("beyond")))
    )
    rows = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", row.alias("r")))).alias("a"))
    header = F.array(s(*map(F.lit, ("Quantity ", "", "Flag", "Flag"))))
    raw = F.concat(header, F.transform("a", lambda x: x["r"]))
    return rows.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("ord"), raw.alias("raw"))


def table_scan(spark, sf):
    return tables.cells(tables.scan(_raw(spark, sf))).select("doc", "row", "column", "cell")


SCAN_SQL = """
WITH k AS (
  SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INTEGER) AS row,
    CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, l_linestatus || ' x' AS s FROM lineitem WHERE l_linenumber NOT IN (6, 7))
SELECT doc, row, 'Quantity' AS "column", q AS cell FROM k UNION ALL SELECT doc, row, 'Flag', s FROM k
"""


def table_stitch(spark, sf):
    """Tables of listed pages put together: orders of a customer as pages."""
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_"), F.col("o_custkey"), "o_orderpriority")
    found = tables.scan(_raw(spark, sf)).join(o, F.col("doc") == F.col("doc_"))
    by_customer = found.select(F.col("o_custkey").alias("doc"), F.col("doc_").alias("page"), "ord", "columns", "rows", "n_rows", "o_orderpriority")
    urgent = by_customer.where("o_orderpriority = '1-URGENT'").select("doc", "page")
    out = tables.stitched(by_customer, urgent)
    return out.select("doc", F.array_join("columns", ",").alias("columns"), F.size("rows").cast("long").alias("n_stacked"), "n_rows")


STITCH_SQL = """
WITH t AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (6, 7) GROUP BY 1)
SELECT o_custkey AS doc, 'Quantity,Flag,Flag' AS columns, CAST(sum(n) AS BIGINT) AS n_stacked, CAST(sum(n) AS BIGINT) AS n_rows
FROM t JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1
"""


def page_render(spark, sf):
    """Turns of a conversation as pages, under headers."""
    c = read_table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return tables.render(c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"))


RENDER_SQL = """
WITH c AS (SELECT conv_id AS doc, turn AS page, min(text) AS text FROM conversations GROUP BY 1, 2)
SELECT doc, string_agg('=== PAGE ' || CAST(page AS VARCHAR) || ' ===' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY page) AS text FROM c GROUP BY doc
"""


def model_replay(spark, sf):
    """Names that stored answers mention: the answers are JSON made from orders, some of it broken."""
    o = read_table(spark, sf, "orders")
    name = F.concat(F.lit("Fund "), (F.col("o_custkey") % 40).cast("string"))
    told = F.array(F.struct(name.alias("name"), (F.col("o_orderkey") % 90 + 1).cast("int").alias("page"), (F.col("o_orderstatus") == "F").alias("has_dedicated_section")))
    text = F.to_json(F.struct(F.lit(1).alias("page_start"), F.lit(30).alias("page_end"), told.alias("funds_mentioned")))
    stored = o.where("o_orderstatus <> 'P'").select(
        F.lit("explore").alias("stage"), F.col("o_orderkey").cast("string").alias("key"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("{broken")).otherwise(text).alias("json"),
    )
    prompts = o.select(F.lit("explore").alias("stage"), F.col("o_orderkey").cast("string").alias("key"), F.lit("read").alias("prompt"))
    found = models.mentions(models.notes(models.Replay(stored).answer(prompts)))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_if("dedicated").alias("n_dedicated"), F.min("page").alias("first_page"))


REPLAY_SQL = """
SELECT 'Fund ' || CAST(o_custkey % 40 AS VARCHAR) AS name, count(*) AS n_mentions, count_if(o_orderstatus = 'F') AS n_dedicated,
  CAST(min(o_orderkey % 90 + 1) AS INTEGER) AS first_page
FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 GROUP BY 1
"""


def html_reports(spark, sf):
    """Suppliers of a nation as funds of one report."""
    s = read_table(spark, sf, "supplier").join(read_table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    values = s.select(
        F.col("n_name").alias("doc"), F.col("s_name").alias("fund"), F.lit("balance").alias("field"), F.format_string("%.2f", "s_acctbal").alias("value"),
        (F.col("s_suppkey") % 10 / 10).alias("confidence"), F.concat(F.lit("<"), "s_name", F.lit(">")).alias("quote"),
    )
    return reports.html_reports(values).select("doc", F.length("html").cast("long").alias("n_chars"), F.md5("html").alias("digest"))


HTML_SQL = f"""
WITH r AS (
  SELECT n_name AS doc, s_name AS fund, '<section><h2>' || s_name || '</h2><table><tr><td>balance</td><td><span class="'
    || CASE WHEN s_suppkey % 10 / 10 >= 0.8 THEN 'high' WHEN s_suppkey % 10 / 10 >= 0.5 THEN 'medium' ELSE 'low' END || '" title="&lt;' || s_name || '&gt;">'
    || printf('%.2f', s_acctbal) || '</span></td></tr></table></section>' AS h
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
d AS (SELECT doc, '<!DOCTYPE html><html><head><style>{reports.STYLE}</style></head><body>' || string_agg(h, '' ORDER BY fund) || '</body></html>' AS html FROM r GROUP BY doc)
SELECT doc, length(html) AS n_chars, md5(html) AS digest FROM d
"""

QUERIES = {
    "table_scan": (table_scan, SCAN_SQL),
    "table_stitch": (table_stitch, STITCH_SQL),
    "page_render": (page_render, RENDER_SQL),
    "model_replay": (model_replay, REPLAY_SQL),
    "html_reports": (html_reports, HTML_SQL),
}
