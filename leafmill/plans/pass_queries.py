"""Queries over later passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import learning, passes, search
from leafmill.session import read_table


def learned_terms(spark, sf):
    d = read_table(spark, sf, "documents").select(F.regexp_extract("text", r"([A-Z]{2}[A-Z0-9]{10})", 1).alias("value"), F.col("doc_id").alias("ord"))
    return passes.learned_terms(d)


LEARNED_SQL = """
WITH v AS (SELECT regexp_extract(text, '([A-Z]{2}[A-Z0-9]{10})', 1) AS value, doc_id AS ord FROM documents)
SELECT value[1:3] AS term, min(ord) AS ord FROM v WHERE value <> '' GROUP BY 1
"""


def learned_terms_whole(spark, sf):
    """What all codes of each text teach; learned_terms takes the first of each."""
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("page"), "text")
    found = search.codes(d, r"([A-Z]{2}[A-Z0-9]{10})")
    return passes.learned_terms(found.select(F.col("code").alias("value"), F.col("page").alias("ord")))


LEARNED_WHOLE_SQL = """
WITH v AS (SELECT unnest(regexp_extract_all(text, '([A-Z]{2}[A-Z0-9]{10})', 1)) AS value, doc_id AS ord FROM documents)
SELECT value[1:3] AS term, min(ord) AS ord FROM v GROUP BY 1
"""


SEEDS = ["isin", "lu0", "license", "ier"]


def learned_search(spark, sf):
    """Documents that hold a seed or, round by round, the first letters of a code on a document found before."""
    d = read_table(spark, sf, "documents").where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    return learning.learned_rows(d.withColumnRenamed("doc_id", "page"), SEEDS, r"([A-Z]{2}[A-Z0-9]{10})").select("kind", "name")


LEARNED_SEARCH_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, lower(text) AS low FROM documents),
c AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '([A-Z]{{2}}[A-Z0-9]{{10}})', 1))[1:3]) AS term FROM d),
r(term) AS (
  SELECT unnest({SEEDS}) UNION SELECT c.term FROM r JOIN d ON contains(d.low, r.term) JOIN c ON c.doc_id = d.doc_id
)
SELECT 'term' AS kind, term AS name FROM r
UNION ALL SELECT DISTINCT 'page', CAST(doc_id AS VARCHAR) FROM d JOIN r ON contains(d.low, r.term)
"""


def _orders(spark, sf):
    o = read_table(spark, sf, "orders")
    start = (F.col("o_orderkey") % 60 + 1).alias("page_start")
    return o.select(F.col("o_custkey").alias("doc"), start, (F.col("o_orderkey") % 60 + 1 + F.col("o_orderkey") % 4).alias("page_end"), F.col("o_orderpriority").alias("kind"), "o_orderstatus")


def gleaned_tables(spark, sf):
    o = _orders(spark, sf)
    return passes.second_tables(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus <> 'F'").drop("o_orderstatus"))


GLEANED_SQL = """
WITH o AS (SELECT o_custkey AS doc, o_orderkey % 60 + 1 AS page_start, o_orderkey % 60 + 1 + o_orderkey % 4 AS page_end, o_orderpriority AS kind, o_orderstatus FROM orders)
SELECT doc, page_start, page_end, kind, false AS again FROM o WHERE o_orderstatus = 'F'
UNION ALL SELECT doc, page_start, page_end, kind, true FROM o WHERE o_orderstatus <> 'F'
  AND NOT EXISTS (SELECT 1 FROM o f WHERE f.o_orderstatus = 'F' AND f.doc = o.doc AND o.page_start BETWEEN f.page_start AND f.page_end)
"""


def gleaned_names(spark, sf):
    p = read_table(spark, sf, "part")
    one = lambda df, name: df.select(F.col("p_brand").alias("doc"), name.alias("name"), F.col("p_partkey").alias("ord"))
    return passes.second_names(one(p.where("p_size < 25"), F.col("p_name")), one(p.where("p_size >= 25"), F.upper("p_name")))


NAMES_SQL = """
WITH u AS (SELECT p_brand AS doc, p_name AS name, p_partkey AS ord, 0 AS again FROM part WHERE p_size < 25
  UNION ALL SELECT p_brand, upper(p_name), p_partkey, 1 FROM part WHERE p_size >= 25)
SELECT doc, name, ord, CAST(again AS INTEGER) AS again FROM u QUALIFY row_number() OVER (PARTITION BY doc, trim(lower(name)) ORDER BY again, ord) = 1
"""


def broadcast_rows(spark, sf):
    """Line items as rows of consolidated tables that overwrite values of supplier and part class."""
    l = read_table(spark, sf, "lineitem")
    s = read_table(spark, sf, "supplier")
    kinds = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))
    classes = s.select(F.col("s_suppkey").alias("fund"), kinds.alias("class"), F.lit("NOT_FOUND").alias("isin"), F.col("s_name").alias("fee"))
    rows = l.groupBy(F.col("l_suppkey").alias("fund"), (F.col("l_partkey") % 4).alias("class"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")).agg(
        F.max("l_returnflag").alias("isin"), F.max(F.when(F.col("l_linenumber") == 1, F.col("l_linestatus"))).alias("fee")
    )
    return passes.apply_rows(classes, rows, ["isin", "fee"])


BROADCAST_SQL = """
WITH c AS (SELECT s_suppkey AS fund, unnest(generate_series(0, 2)) AS class, s_name AS fee FROM supplier),
r AS (SELECT l_suppkey AS fund, l_partkey % 4 AS class, l_orderkey * 10 + l_linenumber AS ord, max(l_returnflag) AS isin,
  max(CASE WHEN l_linenumber = 1 THEN l_linestatus END) AS fee FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT fund, class, arg_max(isin, ord) AS isin, arg_max(fee, CASE WHEN fee IS NOT NULL THEN ord END) AS fee FROM r GROUP BY 1, 2)
SELECT c.fund, c.class, coalesce(m.isin, 'NOT_FOUND') AS isin, coalesce(m.fee, c.fee) AS fee FROM c LEFT JOIN m USING (fund, class)
"""


def table_info(spark, sf):
    e = read_table(spark, sf, "events")
    k = F.col("event_id") % 4
    columns = F.when(k == 0, F.expr("cast(array() as array<string>)")).when(k == 1, F.array(F.lit("ISIN"), F.concat(F.lit("Fund "), "event_type"))).otherwise(F.array(F.lit("Fee"), F.lit("Class")))
    findings = e.select(F.col("user_id").alias("field"), F.array(F.dayofyear("ts").cast("long")).alias("pages"), columns.alias("columns"), F.col("event_id").alias("ord"))
    out = passes.table_info(findings, ["fund", "class"])
    return out.select("field", F.size("pages").cast("long").alias("n_pages"), F.array_join("columns", ",").alias("columns"), "has_name", "name_column")


INFO_SQL = """
WITH e AS (SELECT user_id AS field, dayofyear(ts) AS page, event_id AS ord, event_id % 4 AS k, event_type FROM events),
f AS (SELECT field, count(DISTINCT page) AS n_pages, bool_or(k > 0) AS has_name, arg_min(CASE k WHEN 1 THEN 'ISIN,Fund ' || event_type ELSE 'Fee,Class' END, CASE WHEN k > 0 THEN ord END) AS columns FROM e GROUP BY 1)
SELECT field, n_pages, coalesce(columns, '') AS columns, has_name, nullif(split_part(columns, ',', 2), '') AS name_column FROM f
"""


def exploration_summary(spark, sf):
    from leafmill.plans.planning_queries import _mentions

    out = passes.exploration_summary(_mentions(spark, sf))
    return out.select("doc", "n_names", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


SUMMARY_SQL = """
WITH m AS (SELECT user_id AS doc, json_extract_string(props, '$.k') AS name, dayofyear(ts) AS page, event_type = 'purchase' AS own FROM events)
SELECT doc, count(DISTINCT CASE WHEN own THEN name END) AS n_names,
  array_to_string(list_transform(list_sort(list_distinct(list(CASE WHEN own THEN page END))), lambda x: CAST(x AS VARCHAR)), ',') AS pages FROM m GROUP BY doc
"""


def failure_recovery(spark, sf):
    d, l = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    failed = d.select(F.col("doc_id").alias("id"), F.lit("code").alias("field"))
    code = F.nullif(F.regexp_extract("text", r"([A-Z]{2}[A-Z0-9]{10})", 1), F.lit(""))
    resolved = d.join(l, "doc_id").select(F.col("doc_id").alias("id"), F.lit("code").alias("field"), code.alias("value"), F.when(F.col("quality") == 0, "not_in_document").alias("reason"))
    return passes.recover(failed, resolved).groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


RECOVERY_SQL = """
WITH r AS (SELECT doc_id, nullif(regexp_extract(text, '([A-Z]{2}[A-Z0-9]{10})', 1), '') AS v, CASE WHEN quality = 0 THEN 'not_in_document' END AS why FROM documents JOIN labels USING (doc_id)),
o AS (SELECT CASE WHEN v IS NOT NULL THEN 'resolved' WHEN why IS NOT NULL THEN 'upgraded' ELSE 'failed' END AS outcome,
  CASE WHEN v IS NULL THEN coalesce(why, 'extraction_failed') END AS reason FROM documents LEFT JOIN r USING (doc_id))
SELECT outcome, reason, count(*) AS n FROM o GROUP BY 1, 2
"""


def run_stats(spark, sf):
    e = read_table(spark, sf, "events")
    s = e.groupBy("user_id").agg(
        F.avg(F.when((F.col("event_type") == "signup") & (F.col("user_id") % 3 == 0), 0.7)).alias("critic"), F.count_if(F.col("event_id") % 5 == 0).alias("high"),
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_id") % 7 == 1).alias("missing"),
    )
    return s.select("user_id", F.round(passes.run_score(F.col("critic"), F.col("high"), F.col("total"), F.col("missing")), 6).alias("score"))


RUN_SQL = """
WITH s AS (SELECT user_id, avg(CASE WHEN event_type = 'signup' AND user_id % 3 = 0 THEN 0.7::DOUBLE END) AS critic, count_if(event_id % 5 = 0) AS high, count(*) AS total, count_if(event_id % 7 = 1) AS missing FROM events GROUP BY 1)
SELECT user_id, round(coalesce(critic, CASE WHEN total > missing THEN high / (total - missing) END, 0.0), 6) AS score FROM s
"""


def structure_chunks(spark, sf):
    o = read_table(spark, sf, "orders")
    docs = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_custkey") % 300 + 1).alias("n_pages"))
    start = F.col("o_orderkey") % (F.col("o_custkey") % 300 + 1) + 1
    end = F.least(F.col("o_custkey") % 300 + 1, start + F.col("o_orderkey") % 80)
    sections = o.select(F.col("o_custkey").alias("doc"), F.struct(start, "o_orderkey").alias("ord"), start.alias("page_start"), end.alias("page_end"))
    return passes.structure_aware_chunks(docs, sections)


STRUCTURE_SQL = """
WITH RECURSIVE d AS (SELECT c_custkey AS doc, c_custkey % 300 + 1 AS n FROM customer),
s0 AS (SELECT o_custkey AS doc, n, o_orderkey AS o, o_orderkey % n + 1 AS a FROM orders JOIN d ON d.doc = o_custkey),
s AS (SELECT doc, a, least(n, a + o % 80) AS b, row_number() OVER (PARTITION BY doc ORDER BY a, o) AS k FROM s0),
z AS (SELECT *, b - a + 1 AS size FROM s),
r AS (
  SELECT doc, 0 AS k, CAST(NULL AS BIGINT) AS ca, CAST(NULL AS BIGINT) AS cb, CAST(0 AS BIGINT) AS cs, CAST(NULL AS BIGINT) AS ea, CAST(NULL AS BIGINT) AS eb FROM d
  UNION ALL
  SELECT z.doc, z.k, CASE WHEN size > 50 THEN NULL WHEN ca IS NULL OR cs + size > 50 THEN a ELSE ca END, CASE WHEN size > 50 THEN NULL ELSE b END,
    CASE WHEN size > 50 THEN 0 WHEN ca IS NULL OR cs + size > 50 THEN size ELSE cs + size END,
    CASE WHEN size > 50 OR cs + size > 50 THEN ca END, CASE WHEN size > 50 OR cs + size > 50 THEN cb END
  FROM r JOIN z ON z.doc = r.doc AND z.k = r.k + 1
),
c AS (
  SELECT doc, ea AS a, eb AS b, 'complete' AS kind FROM r WHERE ea IS NOT NULL
  UNION ALL SELECT doc, ca, cb, 'complete' FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc ORDER BY k DESC) = 1) WHERE ca IS NOT NULL
  UNION ALL SELECT doc, x, least(x + 29, b), 'partial_section' FROM (SELECT doc, b, unnest(generate_series(a, b, 30)) AS x FROM z WHERE size > 50)
),
p AS (SELECT doc, unnest(generate_series(1, n)) AS page FROM d WHERE doc IN (SELECT doc FROM z)),
u AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS g FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc = p.doc AND page BETWEEN c.a AND c.b)),
w AS (
  SELECT * FROM c UNION ALL SELECT doc, min(page), max(page), 'gap' FROM u GROUP BY doc, g
  UNION ALL SELECT doc, x, least(x + 29, n), 'naive' FROM (SELECT doc, n, unnest(generate_series(1, n, 30)) AS x FROM d WHERE doc NOT IN (SELECT doc FROM z))
)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY a, b, kind) AS chunk, a AS page_start, b AS page_end, kind FROM w
"""


QUERIES = {
    "learned_terms": (learned_terms, LEARNED_SQL),
    "learned_search": (learned_search, LEARNED_SEARCH_SQL),
    "learned_terms_whole": (learned_terms_whole, LEARNED_WHOLE_SQL),
    "gleaned_tables": (gleaned_tables, GLEANED_SQL),
    "gleaned_names": (gleaned_names, NAMES_SQL),
    "broadcast_rows": (broadcast_rows, BROADCAST_SQL),
    "table_info": (table_info, INFO_SQL),
    "exploration_summary": (exploration_summary, SUMMARY_SQL),
    "failure_recovery": (failure_recovery, RECOVERY_SQL),
    "run_stats": (run_stats, RUN_SQL),
    "structure_chunks": (structure_chunks, STRUCTURE_SQL),
}
