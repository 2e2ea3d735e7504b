"""Queries over typed constraints, references and aligned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import dictionaries as d
from leafmill.functions.text import whole_number
from leafmill.functions.values import in_external_document
from leafmill.operators import constraints, knowledge, planning, references, resolve, search
from leafmill.session import read_table
from leafmill.sources import reports, tables


def _funds(spark, sf):
    """Orders as funds with texts of their own."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("long") % 200
    return read_table(spark, sf, "orders").select(
        k.alias("id"),
        F.when(k % 4 == 0, "NOT_FOUND").when(k % 4 == 1, F.concat(F.lit("max "), p.cast("string"), F.lit("% single issuer; min 5 % liquid; ;European equity"))).alias("restrictions"),
        F.when(k % 3 == 0, F.concat(F.lit("Value at Risk below "), p.cast("string"), F.lit(" percent"))).when(k % 3 == 1, "no borrowing").alias("leverage"),
        F.when(k % 5 == 0, F.concat(F.lit("up to "), p.cast("string"), F.lit("%"))).when(k % 5 == 1, "Limited to hedging").when(k % 5 == 2, "hedging only").alias("derivatives"),
    )


def fund_constraints(spark, sf):
    found = constraints.of_funds(_funds(spark, sf))
    return found.select("*", constraints.family(F.col("type")).alias("family"), constraints.is_predefined(F.col("type")).alias("predefined"))


FUNDS_SQL = """
WITH f AS (SELECT o_orderkey AS k, CAST(trunc(o_totalprice) AS BIGINT) % 200 AS p FROM orders),
r AS (
  SELECT k AS id, 0 AS pos, 'max ' || p || '% single issuer' AS rule, 'concentration_limit' AS type, CAST(p AS DOUBLE) AS value, 'max' AS comparator FROM f WHERE k % 4 = 1
  UNION ALL SELECT k, 1, 'min 5 % liquid', 'liquidity_limit', 5.0, 'min' FROM f WHERE k % 4 = 1
  UNION ALL SELECT k, 2, 'European equity', 'geographic_limit', NULL, NULL FROM f WHERE k % 4 = 1
  UNION ALL SELECT k, NULL, 'Value at Risk below ' || p || ' percent', 'var_limit', CAST(p AS DOUBLE), CASE WHEN p <> 0 THEN 'max' END FROM f WHERE k % 3 = 0
  UNION ALL SELECT k, NULL, 'no borrowing', 'leverage_limit', NULL, NULL FROM f WHERE k % 3 = 1
  UNION ALL SELECT k, NULL, 'up to ' || p || '%', 'derivative_limit', CAST(p AS DOUBLE), CASE WHEN p <> 0 THEN 'max' END FROM f WHERE k % 5 = 0
  UNION ALL SELECT k, NULL, 'Limited to hedging', 'derivative_limit', NULL, NULL FROM f WHERE k % 5 = 1
  UNION ALL SELECT k, NULL, 'hedging only', 'derivative_policy', NULL, NULL FROM f WHERE k % 5 = 2
)
SELECT id, pos, rule, type, value, CASE WHEN coalesce(value, 0) <> 0 THEN 'percent' END AS unit, comparator,
  CASE WHEN type IN ('concentration_limit', 'liquidity_limit', 'geographic_limit') THEN 'investment' WHEN type IN ('var_limit', 'leverage_limit') THEN 'risk' ELSE 'derivative' END AS family,
  true AS predefined
FROM r
"""


def constraint_families(spark, sf):
    return constraints.by_family(constraints.of_funds(_funds(spark, sf)))


FAMILIES_SQL = f"SELECT family, predefined, count(*) AS n, count(DISTINCT id) AS ids FROM ({FUNDS_SQL}) GROUP BY 1, 2"


def share_class_constraints(spark, sf):
    """Customers as share classes: hedged or not, for some investors, with a minimum and a period."""
    k = F.col("c_custkey")
    classes = read_table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 4 == 0, F.lit(False)).when(k % 4 < 3, F.lit(True)).alias("hedged"),
        F.when(k % 3 == 0, "Fully hedged").when(k % 3 == 1, F.concat((k % 90).cast("string"), F.lit("% target"))).alias("hedging"),
        F.when(k % 7 == 0, "NOT_FOUND").when(k % 7 < 4, F.concat(F.lit("Only "), F.lower("c_mktsegment"))).alias("investors"),
        F.when(k % 2 == 0, F.concat(F.lit("USD "), (k * 10).cast("string"))).when(k % 10 == 1, "some").alias("minimum"),
        F.when(k % 5 == 0, "six months").when(k % 5 == 1, "unclear").alias("holding"),
    )
    return constraints.of_classes(classes)


CLASSES_SQL = """
WITH c AS (SELECT c_custkey AS k, lower(c_mktsegment) AS segment FROM customer),
h AS (SELECT k, CASE k % 3 WHEN 0 THEN 'Fully hedged' WHEN 1 THEN (k % 90) || '% target' END AS rule, CASE k % 3 WHEN 0 THEN 100.0::DOUBLE WHEN 1 THEN CAST(k % 90 AS DOUBLE) END AS value FROM c WHERE k % 4 <> 0)
SELECT k AS id, rule, 'hedging_policy' AS type, value, CASE WHEN value <> 0 THEN 'percent' END AS unit, CASE WHEN value <> 0 THEN 'exact' END AS comparator FROM h WHERE rule IS NOT NULL
UNION ALL SELECT k, 'Currency hedged (details not specified)', 'hedging_policy', NULL, NULL, NULL FROM h WHERE rule IS NULL AND k % 4 < 3
UNION ALL SELECT k, 'Only ' || segment, 'investor_eligibility', NULL, NULL, NULL FROM c WHERE k % 7 BETWEEN 1 AND 3
UNION ALL SELECT k, 'USD ' || k * 10, 'minimum_investment', CAST(k * 10 AS DOUBLE), 'USD', CASE WHEN k <> 0 THEN 'min' END FROM c WHERE k % 2 = 0
UNION ALL SELECT k, 'some', 'minimum_investment', NULL, 'currency', NULL FROM c WHERE k % 10 = 1
UNION ALL SELECT k, 'six months', 'holding_period', 180, 'days', 'min' FROM c WHERE k % 5 = 0
UNION ALL SELECT k, 'unclear', 'holding_period', NULL, NULL, NULL FROM c WHERE k % 5 = 1
"""

#: Ends of references, by their document's number.
ENDS = ["the KIID", "Key Investor fees", "an annual report", "supplement A", "www.site charges", "appendix B", "performance at http:", "risk", ""]


def _references(spark, sf):
    """Beginnings of documents as references of their sources."""
    k = F.col("doc_id")
    text = F.concat(F.regexp_replace(F.left("text", F.lit(12)), "[^a-z]", ""), F.when(k % 11 == 10, "").otherwise(" "), F.get(F.array(*map(F.lit, ENDS)), (k % len(ENDS)).cast("int")))
    return read_table(spark, sf, "documents").select(
        k.alias("id"), F.col("source").alias("doc"), F.trim(text).alias("text"), F.when(k % 7 == 0, F.lit(True)).when(k % 7 < 4, F.lit(False)).alias("is_external"),
        F.when(k % 5 == 0, "isin").when(k % 5 == 1, "").alias("field_hint"), F.when(k % 13 == 0, "Factsheet").alias("external_doc"),
        (k % 50).alias("source_page"), F.when(k % 3 == 0, k % 90).alias("target_page"), F.when(k % 4 > 0, F.col("lang")).alias("target"),
    )


REFERENCES_SQL = f"""
SELECT doc_id AS id, source AS doc, trim(regexp_replace(text[1:12], '[^a-z]', '', 'g') || CASE WHEN doc_id % 11 = 10 THEN '' ELSE ' ' END || {ENDS!r}[doc_id % {len(ENDS)} + 1]) AS text,
  CASE WHEN doc_id % 7 = 0 THEN true WHEN doc_id % 7 < 4 THEN false END AS is_external, CASE doc_id % 5 WHEN 0 THEN 'isin' WHEN 1 THEN '' END AS field_hint,
  CASE WHEN doc_id % 13 = 0 THEN 'Factsheet' END AS external_doc, doc_id % 50 AS source_page, CASE WHEN doc_id % 3 = 0 THEN doc_id % 90 END AS target_page,
  CASE WHEN doc_id % 4 > 0 THEN lang END AS target FROM documents
"""


def references_classified(spark, sf):
    return references.classified(_references(spark, sf)).select("id", "text", "external", "field", "document", "page")


def _first(pairs) -> str:
    return " ".join(f"WHEN contains(low, '{w}') THEN '{v}'" for w, v in pairs)


CLASSIFIED_SQL = f"""
WITH r AS (SELECT *, lower(text) AS low FROM ({REFERENCES_SQL}) WHERE text <> ''),
e AS (SELECT *, coalesce(is_external, false) OR {" OR ".join(f"contains(low, '{w}')" for w in d.EXTERNAL_WORDS)} AS external FROM r)
SELECT id, text, external, CASE WHEN external THEN coalesce(nullif(field_hint, ''), CASE {_first(d.REFERENCE_FIELDS)} END, 'unknown') END AS field,
  CASE WHEN external THEN coalesce(external_doc, CASE {_first(d.EXTERNAL_NAMES)} END, 'External Document') END AS document,
  CASE WHEN NOT external THEN coalesce(nullif(target_page, 0), source_page) END AS page FROM e
"""


def references_attributed(spark, sf):
    """References of sources, with orders as the page index that names the funds of their pages."""
    k = F.col("o_orderkey")
    index = read_table(spark, sf, "orders").select(
        F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string")).alias("doc"), (k % 50).alias("page"), F.when(k % 4 > 0, F.concat(F.lit("fund "), (F.col("o_custkey") % 30).cast("string"))).alias("fund"), k.alias("ord")
    )
    return references.attributed(_references(spark, sf), index)


ATTRIBUTED_SQL = f"""
WITH i AS (SELECT 'src' || (o_custkey % 20) AS doc, o_orderkey % 50 AS source_page, arg_min('fund ' || (o_custkey % 30), o_orderkey) AS fund FROM orders WHERE o_orderkey % 4 > 0 GROUP BY 1, 2)
SELECT 'references' AS type, 'fund:' || fund AS subject, 'section:' || coalesce(target, 'unknown') AS object, text, nullif(target_page, 0) AS page, source_page
FROM ({REFERENCES_SQL}) JOIN i USING (doc, source_page) WHERE text <> '' AND NOT coalesce(is_external, false)
"""


def table_fields(spark, sf):
    """Types of parts as types of tables: the fields they speak of."""
    p = read_table(spark, sf, "part")
    kind = F.concat_ws(" ", F.when(F.col("p_size") % 3 == 0, "Fees and ISIN").when(F.col("p_size") % 3 == 1, "SHARE classes"), "p_type")
    return p.select("p_partkey", references.table_field(kind).alias("field"))


FIELDS_SQL = """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'isin' WHEN p_size % 3 = 1 THEN 'share_class' WHEN contains(lower(p_type), 'isin') THEN 'isin'
  WHEN contains(lower(p_type), 'fee') THEN 'fee' WHEN contains(lower(p_type), 'share') THEN 'share_class' END AS field FROM part
"""


def table_align(spark, sf):
    """A customer's orders as tables of one document: every third has a misspelt, a foreign and a missing column."""
    l, o = read_table(spark, sf, "lineitem"), read_table(spark, sf, "orders")
    s = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    # Rows of strings are made once line items are put together: narrow ones are sorted and shuffled.
    rows = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))).alias("a"))
    q, f = lambda x: x["l_quantity"].cast("int").cast("string"), lambda x: x["l_returnflag"]
    plain = F.concat(F.array(s("Quantity", "Flag", "Note")), F.transform("a", lambda x: s(q(x), f(x), "a")))
    other = F.concat(F.array(s("Flag", "Quanttity", "Remark")), F.transform("a", lambda x: s(f(x), q(x), "b")))
    raw = rows.select(F.col("l_orderkey").alias("page"), F.when(F.col("l_orderkey") % 3 != 0, plain).otherwise(other).alias("raw"))
    raw = raw.join(o.select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("doc")), "page").withColumn("ord", F.lit(0))
    out = tables.stitched(tables.scan(raw))
    each = out.select("doc", F.posexplode("rows").alias("row", "r")).select("doc", "row", F.explode("r").alias("x"))
    return each.groupBy("doc", F.col("x.name").alias("column")).agg(F.count(F.lit(1)).alias("n"), F.sum(whole_number(F.col("x.cell"))).alias("total"))


ALIGN_SQL = """
WITH l AS (SELECT o_custkey AS doc, l_orderkey AS page, CAST(l_quantity AS INTEGER) AS q, l_orderkey % 3 <> 0 AS plain FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT doc, arg_min(plain, page) AS first FROM l GROUP BY doc),
c AS (SELECT l.*, first FROM l JOIN f USING (doc))
SELECT doc, CASE WHEN first THEN 'Quantity' ELSE 'Quanttity' END AS "column", count(*) AS n, CAST(sum(q) AS BIGINT) AS total FROM c GROUP BY doc, first
UNION ALL SELECT doc, 'Flag', count(*), NULL FROM c GROUP BY doc
UNION ALL SELECT doc, CASE WHEN first THEN 'Note' ELSE 'Remark' END, count(*), NULL FROM c WHERE plain = first GROUP BY doc, first
"""


def lookup_columns(spark, sf):
    """Headers made of names of parts: the column to look rows up by, and columns found by a near name."""
    p, k = read_table(spark, sf, "part"), F.col("p_partkey")
    columns = F.array(F.lit("Code"), F.col("p_brand"), F.when(k % 3 == 0, "FUND").otherwise("Class Name"), F.when(k % 2 == 0, "Management fee").otherwise("Price"))
    headers = p.select(k.alias("id"), columns.alias("columns"), F.when(k % 5 == 0, " code ").otherwise("fee Managment").alias("target"))
    return tables.found_columns(headers).join(headers.select("id", tables.lookup_column(F.col("columns")).alias("by")), "id")


LOOKUP_SQL = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN ' code ' ELSE 'fee Managment' END AS target,
  CASE WHEN p_partkey % 5 = 0 THEN 'Code' WHEN p_partkey % 2 = 0 THEN 'Management fee' END AS "column",
  CASE WHEN p_partkey % 3 = 0 THEN 'FUND' ELSE 'Class Name' END AS "by" FROM part
"""



def category_pages(spark, sf):
    pages = read_table(spark, sf, "documents").select(F.col("doc_id").alias("page"), "text")
    turns = read_table(spark, sf, "conversations").select((-F.col("conv_id") * 100 - F.col("turn")).alias("page"), "text")
    return search.category_pages(pages.unionByName(turns), d.SEARCH_TERMS)


CATEGORY_SQL = f"""
WITH t(category, term_ord, term) AS (VALUES {", ".join(f"('{c}', {i}, '{x}')" for c, words in d.SEARCH_TERMS.items() for i, x in enumerate(words))}),
p AS (SELECT doc_id AS page, text FROM documents UNION ALL SELECT -conv_id * 100 - turn, text FROM conversations)
SELECT category, term_ord, term, count(*) AS n_pages, min(page) AS first_page FROM p JOIN t ON contains(lower(text), lower(term)) GROUP BY 1, 2, 3
"""


def canonical_names(spark, sf):
    """Customers of a nation and segment as mentions of one entity."""
    c = read_table(spark, sf, "customer")
    name = F.concat(F.repeat(F.lit("x"), (F.col("c_custkey") % 7).cast("int")), "c_name")
    mentions = c.select(
        F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("cluster"), name.alias("name"), F.col("c_custkey").alias("ord"),
        (F.col("c_acctbal") > 9000).alias("from_toc"), (F.col("c_acctbal") < -500).alias("dedicated"),
    )
    return resolve.canonical_names(mentions)


CANONICAL_SQL = """
WITH m AS (SELECT c_nationkey || '/' || c_mktsegment AS cluster, repeat('x', CAST(c_custkey % 7 AS INTEGER)) || c_name AS name, c_custkey AS ord, c_acctbal AS b FROM customer)
SELECT cluster, coalesce(arg_min(name, ord) FILTER (b > 9000), arg_min(name, ord) FILTER (b < -500), first(name ORDER BY length(name), ord)) AS canonical FROM m GROUP BY 1
"""


def umbrella_names(spark, sf):
    """Segments and types in several spellings, of which some are umbrellas."""
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.col("c_mktsegment")).when(k % 3 == 1, F.concat("c_mktsegment", F.lit(" -  Funds"))).otherwise(F.concat(F.lower("c_mktsegment"), F.lit("funds")))
    return c.select("c_custkey", resolve.is_umbrella(name, ["building", "machinery funds", "automobile funds"]).alias("umbrella"))


UMBRELLA_SQL = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment = 'BUILDING' ELSE c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') END AS umbrella FROM customer
"""


def knowledge_stats(spark, sf):
    """Events as findings of their users."""
    e = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return knowledge.knowledge_stats(e.select(
        F.col("user_id").alias("doc"), F.col("event_type").alias("type"), F.when(k % 3 > 0, F.concat(F.lit("f"), (k % 9).cast("string"))).alias("field"),
        F.when(k % 4 == 0, k).alias("entity"), F.when(k % 5 == 0, "high").when(k % 5 == 1, "medium").alias("priority"), F.when(k % 2 == 0, k % 7 == 0).alias("resolved"),
    ))


STATS_SQL = """
WITH e AS (SELECT user_id AS doc, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
f AS (SELECT *, CASE WHEN k % 3 > 0 THEN 'f' || (k % 9) END AS field, k % 5 < 2 AND NOT (k % 2 = 0 AND k % 7 = 0) AS o FROM e)
SELECT doc, count(*) AS n_findings, count(DISTINCT event_type) AS n_types, count(DISTINCT field) AS n_fields, count(DISTINCT CASE WHEN k % 4 = 0 THEN k END) AS n_entities,
  count_if(o) AS n_open, count_if(o AND k % 5 = 0) AS n_urgent, coalesce(string_agg(DISTINCT field, ',' ORDER BY field), '') AS fields FROM f GROUP BY doc
"""


def rows_about(spark, sf):
    """Suppliers' rows in the tables of their nations, looked up by a name with a slip."""
    s, n = read_table(spark, sf, "supplier"), read_table(spark, sf, "nation")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    cell = lambda name, c: F.struct(F.lit(name).alias("name"), c.cast("string").alias("cell"))
    cells = F.array(cell("Class", F.concat(F.lit(" "), "n_name", F.lit(" "), (F.col("s_suppkey") % 100).cast("string"))), cell("Balance", F.col("s_acctbal")), cell("Fund", F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_name"))))
    return resolve.rows_about(j.select(F.col("s_nationkey").alias("doc"), F.lower("n_name").alias("entity"), F.col("s_suppkey").alias("row"), cells.alias("cells")))


def first_rows(spark, sf):
    """The last five orders of each customer, as a preview of an audit."""
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", (-F.col("o_orderkey")).alias("newest"))
    return tables.per_document(o, "newest", 5).drop("newest")


FIRST_SQL = "SELECT o_custkey AS doc, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 5"


def fund_search(spark, sf):
    """Parts as funds of a report, found by a piece of their name in any case."""
    return reports.find_funds(read_table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("fund")), "EE")


FUND_SQL = "SELECT p_partkey, p_name AS fund FROM part WHERE contains(lower(p_name), 'ee')"


def external_values(spark, sf):
    """References to other documents as extracted values."""
    told = references.classified(_references(spark, sf)).where("external")
    return told.select("id", in_external_document(F.col("document"), F.col("text")).alias("v")).select("id", "v.value", "v.source_quote", "v.confidence", "v.not_found_reason", "v.external_reference")


EXTERNAL_SQL = f"""
SELECT id, 'NOT_FOUND' AS value, text[1:100] AS source_quote, 0.95::DOUBLE AS confidence, 'in_external_doc' AS not_found_reason, document AS external_reference
FROM ({CLASSIFIED_SQL}) WHERE external
"""


def _dated(spark, sf):
    """Beginnings of documents around words, dates and times."""
    k = F.col("doc_id")
    pick = lambda n, *x: F.get(F.array(*map(F.lit, x)), (k % n).cast("int"))
    text = F.concat_ws(
        " ", F.left("text", F.lit(60)), pick(5, "the Payment", "no word", "Dividend and distribution", "Distribution, payment", "NAV calculation"), F.left("text", F.lit(40)),
        pick(4, "3rd  jan and March 5, 12/24 or 1/2", "April 7", "none", "at 10:30 a.m. or 11.45"), pick(3, "Pricing", "valuation point", "-"), F.left("text", F.lit(90)), pick(7, "9.15 CET", "", "12/3", "17:00hours", "1 May", "x", "y"),
    )
    return read_table(spark, sf, "documents").select(k.alias("page"), text.alias("text"))


def _dated_sql() -> str:
    pick = lambda n, *x: f"{list(x)!r}[doc_id % {n} + 1]"
    parts = [
        "text[1:60]", pick(5, "the Payment", "no word", "Dividend and distribution", "Distribution, payment", "NAV calculation"), "text[1:40]",
        pick(4, "3rd  jan and March 5, 12/24 or 1/2", "April 7", "none", "at 10:30 a.m. or 11.45"), pick(3, "Pricing", "valuation point", "-"), "text[1:90]", pick(7, "9.15 CET", "", "12/3", "17:00hours", "1 May", "x", "y"),
    ]
    return f"SELECT doc_id AS page, concat_ws(' ', {', '.join(parts)}) AS text FROM documents"


def _near_sql(words, patterns, before, after, most, quote) -> str:
    found = " || ".join(f"regexp_extract_all(near, '(?i){p}')" for p in patterns)
    return f"""
WITH w(ord, keyword) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(words))}),
p AS (SELECT page, text, ord, keyword, strpos(lower(text), keyword) AS place FROM ({_dated_sql()}), w),
n AS (SELECT page, ord, keyword, text[greatest(place - 1 - {before}, 0) + 1:place - 1 + {after}] AS near FROM p WHERE place > 0),
m AS (SELECT *, {found} AS found FROM n)
SELECT page, keyword, array_to_string(found[1:{most}], ', ') AS value, trim(near)[1:{quote}] AS quote FROM m WHERE len(found) > 0
QUALIFY row_number() OVER (PARTITION BY page ORDER BY ord) = 1
"""


def dividend_dates(spark, sf):
    return search.dividend_dates(_dated(spark, sf))


def valuation_times(spark, sf):
    return search.valuation_times(_dated(spark, sf))



def _classes_and_found(spark, sf):
    """Orders of a customer as share classes, and as what a search found for them under whole, shorter and strange names."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    code = F.concat(F.lit("LU"), F.lpad(k.cast("string"), 10, "0"))
    o = read_table(spark, sf, "orders")
    classes = o.select(F.col("o_custkey").alias("fund"), k.alias("ord"), F.concat(p, F.lit(" "), (k % 3).cast("string")).alias("name"),
                       F.when(k % 5 == 0, code).when(k % 5 == 1, "NOT_FOUND").alias("code"), F.when(k % 4 == 0, F.concat((k % 9).cast("string"), F.lit("%"))).alias("fee"))
    name = F.when(k % 4 == 0, F.concat(p, F.lit(" 1"))).when(k % 4 == 1, F.lower(F.substring(p, 3, 20))).when(k % 4 == 2, F.concat(F.lit("class "), p, F.lit(" 2"))).otherwise("other")
    found = o.select(F.col("o_custkey").alias("fund"), (-k).alias("ord"), name.alias("name"), F.when(k % 7 == 0, "LU1").otherwise(F.concat(F.lit("IE"), F.lpad(k.cast("string"), 10, "0"))).alias("code"),
                     F.when(k % 6 == 0, "NOT_FOUND").otherwise(F.concat((k % 8).cast("string"), F.lit(" bp"))).alias("fee"))
    return classes, found


def code_merge(spark, sf):
    classes, found = _classes_and_found(spark, sf)
    return planning.merge_codes(classes.drop("fee"), found.drop("fee"))


def fee_merge(spark, sf):
    classes, found = _classes_and_found(spark, sf)
    return planning.merge_fees(classes.drop("code"), found.drop("code"), ["fee"])


FEES_SQL = """
WITH c AS (SELECT o_custkey AS fund, o_orderkey AS ord, o_orderpriority || ' ' || (o_orderkey % 3) AS name, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 9) || '%' END AS fee FROM orders),
f AS (SELECT o_custkey AS fund, -o_orderkey AS told, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority || ' 1' WHEN 1 THEN lower(o_orderpriority[3:]) WHEN 2 THEN 'class ' || o_orderpriority || ' 2' ELSE 'other' END AS n,
  CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 8) || ' bp' END AS new FROM orders),
t AS (SELECT fund, told, new, min(ord) AS ord FROM f JOIN c USING (fund) WHERE c.name = n OR contains(lower(c.name), lower(n)) GROUP BY 1, 2, 3),
w AS (SELECT fund, ord, arg_min(new, told) FILTER (new IS NOT NULL) AS new FROM t GROUP BY 1, 2)
SELECT c.fund, c.ord, name, coalesce(fee, new) AS fee FROM c LEFT JOIN w USING (fund, ord)
"""


QUERIES = {
    "code_merge": (code_merge, None),
    "fee_merge": (fee_merge, FEES_SQL),
    "dividend_dates": (dividend_dates, _near_sql(d.DIVIDEND_WORDS, d.DATES, 100, 300, 4, 150)),
    "valuation_times": (valuation_times, _near_sql(d.VALUATION_WORDS, [d.TIME], 0, 150, 1, 100)),
    "category_pages": (category_pages, CATEGORY_SQL),
    "canonical_names": (canonical_names, CANONICAL_SQL),
    "umbrella_names": (umbrella_names, UMBRELLA_SQL),
    "knowledge_stats": (knowledge_stats, STATS_SQL),
    "rows_about": (rows_about, None),
    "first_rows": (first_rows, FIRST_SQL),
    "fund_search": (fund_search, FUND_SQL),
    "external_values": (external_values, EXTERNAL_SQL),
    "fund_constraints": (fund_constraints, FUNDS_SQL),
    "constraint_families": (constraint_families, FAMILIES_SQL),
    "share_class_constraints": (share_class_constraints, CLASSES_SQL),
    "references_classified": (references_classified, CLASSIFIED_SQL),
    "references_attributed": (references_attributed, ATTRIBUTED_SQL),
    "table_fields": (table_fields, FIELDS_SQL),
    "table_align": (table_align, ALIGN_SQL),
    "lookup_columns": (lookup_columns, LOOKUP_SQL),
}
