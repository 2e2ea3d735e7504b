"""Queries over plans, references, share classes and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import enrichment, planning, structure
from leafmill.session import read_table


def _mentions(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("doc"), F.concat(F.lit("fund "), F.get_json_object("props", "$.k")).alias("name"),
        F.dayofyear("ts").cast("long").alias("page"), (F.col("event_type") == "purchase").alias("dedicated"), F.col("event_id").alias("ord"),
    )


def mention_ranges(spark, sf):
    return planning.mention_ranges(_mentions(spark, sf), F.lit(31).cast("long"))


RANGES_SQL = """
WITH m AS (SELECT user_id AS doc, 'fund ' || json_extract_string(props, '$.k') AS name, CAST(dayofyear(ts) AS BIGINT) AS page, event_id AS ord
  FROM events WHERE event_type = 'purchase'),
n AS (SELECT *, lead(page) OVER (PARTITION BY doc ORDER BY page, ord) AS next FROM m)
SELECT doc, name, page AS page_start, CASE WHEN next IS NULL THEN least(page + 4, 31) ELSE least(greatest(page, next - 1), page + 5) END AS page_end
FROM n QUALIFY row_number() OVER (PARTITION BY doc, name ORDER BY page DESC, ord DESC) = 1
"""


def toc_children(spark, sf):
    """Line items of an order as contents entries: levels from line numbers, titles from ship modes of status."""
    l = read_table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_returnflag").alias("f"))
    toc = l.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), (F.col("p") % 3 + 1).alias("level"),
        F.concat(F.when(F.col("f") == "R", "The Sub-Funds ").otherwise("Part "), F.col("p").cast("string")).alias("title"),
    )
    return planning.children_of_first(toc, ["sub-fund", "compartment"])


CHILDREN_SQL = """
WITH t AS (SELECT l_orderkey AS doc, l_linenumber AS ord, max(l_partkey) % 3 + 1 AS level,
  CASE WHEN max(l_returnflag) = 'R' THEN 'The Sub-Funds ' ELSE 'Part ' END || CAST(max(l_partkey) AS VARCHAR) AS title FROM lineitem GROUP BY 1, 2),
p AS (SELECT doc, min(ord) AS po, arg_min(level, ord) AS pl FROM t WHERE contains(lower(title), 'sub-fund') GROUP BY doc),
b AS (SELECT t.*, pl, max(CASE WHEN level <= pl THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord) AS ended FROM t JOIN p USING (doc) WHERE ord > po)
SELECT doc, ord, title FROM b WHERE ended = 0 AND level = pl + 1
"""


def page_range_sources(spark, sf):
    """Ranges of each document from runs of pages, else from mentions."""
    runs = structure.runs(_mentions(spark, sf).where("dedicated"), "doc").select("doc", F.concat(F.lit("run "), F.col("run").cast("string")).alias("name"), "page_start", "page_end")
    return planning.first_source(runs, mention_ranges(spark, sf))


SOURCES_SQL = f"""
WITH p AS (SELECT DISTINCT user_id AS doc, CAST(dayofyear(ts) AS BIGINT) AS page FROM events WHERE event_type = 'purchase'),
i AS (SELECT *, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS island FROM p),
g AS (SELECT doc, min(page) AS page_start, max(page) AS page_end FROM i GROUP BY doc, island),
r AS (SELECT doc, 'run ' || CAST(row_number() OVER (PARTITION BY doc ORDER BY page_start) AS VARCHAR) AS name, page_start, page_end, 0 AS source FROM g),
u AS (SELECT * FROM r UNION ALL SELECT *, 1 FROM ({RANGES_SQL}))
SELECT * FROM u QUALIFY source = min(source) OVER (PARTITION BY doc)
"""


def location_logic(spark, sf):
    o = read_table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.bool_or(F.col("o_totalprice") > 300_000).alias("far"), F.array_sort(F.collect_set(F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_orderkey") % 50))).alias("pages")
    )
    return o.select("o_custkey", planning.location(F.col("far"), F.col("pages")).alias("location"), F.size("pages").cast("long").alias("n_pages"))


LOCATION_SQL = """
WITH o AS (SELECT o_custkey, bool_or(o_totalprice > 300000) AS far, count(DISTINCT CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderkey % 50 END) AS n_pages FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN far THEN 'external' WHEN n_pages > 0 THEN 'consolidated_table' ELSE 'per_fund_inline' END AS location, n_pages FROM o
"""


def extraction_recipes(spark, sf):
    l = read_table(spark, sf, "lineitem").join(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "A", "isin").when(F.col("l_returnflag") == "R", "fee").otherwise("risk")
    funds = l.groupBy(F.col("o_custkey").alias("fund")).agg(F.collect_set(kind).alias("tables"))
    return planning.recipes(funds, ["isin", "fee", "risk", "objective"], ["isin", "fee"])


RECIPES_SQL = """
WITH t AS (SELECT o_custkey AS fund, bool_or(l_returnflag = 'A') AS i, bool_or(l_returnflag = 'R') AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT fund, field, CASE WHEN (field = 'isin' AND i) OR (field = 'fee' AND f) THEN 'table_lookup' ELSE 'text_extraction' END AS source
FROM t CROSS JOIN (VALUES ('isin'), ('fee'), ('risk'), ('objective')) v(field)
"""


def reference_resolver(spark, sf):
    """References written from orders, resolved in the sections of their customer."""
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("See pages "), (k % 80 + 1).cast("string"), F.lit(" - "), (k % 90 + 1).cast("string")))
        .when(k % 5 == 1, F.concat(F.lit("refer to Annex "), F.chr(k % 4 + 65)))
        .when(k % 5 == 2, F.concat(F.lit("cf. Section "), (k % 6 + 1).cast("string")))
        .when(k % 5 == 3, F.lit("the Risk Factors of Funds")).otherwise(F.lit("elsewhere"))
    )
    refs = o.select(F.col("o_custkey").alias("doc"), k.alias("ref"), text.alias("text"))
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ord"))
    name = F.element_at(F.array(*map(F.lit, ("Annex A", "Annex B", "3 Fees", "Risk factors for funds", "5 Dealing"))), F.col("ord") + 1)
    sections = c.select("doc", "ord", name.alias("name"), (F.col("doc") % 7 + F.col("ord") * 10 + 1).alias("page_start"), (F.col("doc") % 7 + F.col("ord") * 10 + 9).alias("page_end"))
    return planning.resolve_references(refs, sections)


REFERENCE_SQL = """
WITH r AS (SELECT o_custkey AS doc, o_orderkey AS ref, o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
s(ord, name) AS (VALUES (0, 'annex a'), (1, 'annex b'), (2, '3 fees'), (3, 'risk factors for funds'), (4, '5 dealing')),
m AS (SELECT doc, ref, k, CASE k % 5 WHEN 1 THEN CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END WHEN 2 THEN CASE k % 6 + 1 WHEN 3 THEN 2 WHEN 5 THEN 4 END WHEN 3 THEN 3 END AS ord FROM r),
o AS (SELECT o_orderkey, o_custkey FROM orders)
SELECT doc, ref, k % 80 + 1 AS page_start, greatest(k % 80 + 1, k % 90 + 1) AS page_end, 'pages' AS how FROM r WHERE k % 5 = 0
UNION ALL SELECT o_custkey, o_orderkey, o_orderkey % 80 + 1, greatest(o_orderkey % 80 + 1, o_orderkey % 90 + 1), 'pages' FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT doc, ref, doc % 7 + ord * 10 + 1, doc % 7 + ord * 10 + 9, CASE k % 5 WHEN 1 THEN 'appendix' WHEN 2 THEN 'number' ELSE 'name' END FROM m WHERE ord IS NOT NULL
"""


def class_merge(spark, sf):
    c, o = read_table(spark, sf, "customer"), read_table(spark, sf, "orders")
    base = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "NOT_FOUND").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).alias("fee"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("isin"))
    updates = o.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("fee"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("isin"), F.col("o_orderkey").alias("ord"))
    return planning.merge_classes(base, updates, ["c_custkey"], ["fee", "isin"])


CLASS_SQL = """
WITH b AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN c_mktsegment END AS fee, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS isin FROM customer),
u AS (SELECT o_custkey AS c_custkey, arg_max(o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) AS nf, arg_max(o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) AS ni FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN fee IS NULL OR fee = 'NOT_FOUND' THEN coalesce(nf, fee) ELSE fee END AS fee,
  CASE WHEN isin IS NULL OR isin = 'NOT_FOUND' THEN coalesce(ni, isin) ELSE isin END AS isin FROM b LEFT JOIN u USING (c_custkey)
"""


def class_constraints(spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    classes = c.select(
        k.alias("id"), F.when(k % 3 == 0, "Fully hedged").when(k % 3 == 1, F.concat((k % 90).cast("string"), F.lit("% target"))).alias("hedging"),
        F.when(k % 2 == 0, F.concat(F.lit("USD "), (k * 10).cast("string"))).otherwise("NOT_FOUND").alias("minimum"),
        F.when(k % 5 == 0, F.lit("six months")).when(k % 5 == 1, F.lit("unclear")).alias("holding"),
    )
    return planning.class_constraints(classes)


CONSTRAINTS_SQL = """
SELECT c_custkey AS id, 'hedging_policy' AS type, CAST(CASE c_custkey % 3 WHEN 0 THEN 100 ELSE c_custkey % 90 END AS DOUBLE) AS value, 'percent' AS unit, 'exact' AS comparator FROM customer WHERE c_custkey % 3 < 2
UNION ALL SELECT c_custkey, 'minimum_investment', CAST(c_custkey * 10 AS DOUBLE), 'USD', 'min' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'holding_period', CASE c_custkey % 5 WHEN 0 THEN 180.0::DOUBLE END, CASE c_custkey % 5 WHEN 0 THEN 'days' END, CASE c_custkey % 5 WHEN 0 THEN 'min' END FROM customer WHERE c_custkey % 5 < 2
"""


def missing_reasons(spark, sf):
    d, l = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    j = d.join(l, "doc_id", "left")
    reason = planning.not_found_reason(F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("lang") == "de", F.coalesce(F.col("quality") == 0, F.lit(False)), F.contains("text", F.lit("icense")))
    return j.groupBy(reason.alias("reason"), "lang").agg(F.count(F.lit(1)).alias("n"))


REASONS_SQL = """
SELECT CASE WHEN toxic = 1 THEN 'not_applicable' WHEN lang = 'de' THEN 'in_external_doc' WHEN quality = 0 THEN 'not_in_document'
  WHEN contains(text, 'icense') THEN 'in_external_doc' ELSE 'extraction_failed' END AS reason, lang, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2
"""


def error_rollup(spark, sf):
    e = read_table(spark, sf, "events")
    errors = e.select(F.col("event_type").alias("category"), F.when(F.col("event_id") % 4 == 0, "warning").otherwise("error").alias("severity"), F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("u"), (F.col("user_id") % 12).cast("string"))).alias("entity"))
    return planning.errors_by_category(errors)


ERRORS_SQL = """
SELECT event_type AS category, count_if(event_id % 4 <> 0) AS n_errors, count_if(event_id % 4 = 0) AS n_warnings,
  array_to_string(list_sort(list_distinct(list(CASE WHEN event_id % 4 <> 0 AND event_id % 9 = 0 THEN 'u' || CAST(user_id % 12 AS VARCHAR) END))), ',') AS entities
FROM events GROUP BY 1
"""


def graph_stats(spark, sf):
    return planning.counts_with_zeros(read_table(spark, sf, "events"), "event_type", ["click", "purchase", "view", "fund", "share_class"])


STATS_SQL = """
SELECT kind, count(event_id) AS n FROM (VALUES ('click'), ('purchase'), ('view'), ('fund'), ('share_class')) v(kind) LEFT JOIN events ON event_type = kind GROUP BY 1
"""


def critic_scores(spark, sf):
    c = read_table(spark, sf, "conversations")
    n = F.length("text") % 5
    word = F.when(n == 0, "high").when(n == 1, "medium").when(n == 2, "low").when(n == 3, "not_found")
    return planning.critic_score(c.select("conv_id", word.alias("word")), "conv_id").select("conv_id", F.round("score", 6).alias("score"))


CRITIC_SQL = """
SELECT conv_id, round(coalesce(avg(CASE length(text) % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.3::DOUBLE WHEN 3 THEN 0.0::DOUBLE END), 0.5), 6) AS score FROM conversations GROUP BY 1
"""


def link_funds_to_tables(spark, sf):
    """Suppliers of a nation with the consolidated tables (market segments) of its customers, but for links made already."""
    s, c = read_table(spark, sf, "supplier"), read_table(spark, sf, "customer")
    funds = s.select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("fund"))
    tables = c.select(F.col("c_nationkey").alias("doc"), F.col("c_mktsegment").alias("table")).distinct()
    made = c.select(F.col("c_nationkey").alias("doc"), (F.col("c_custkey") % 50).alias("fund"), F.col("c_mktsegment").alias("table")).distinct()
    return planning.link_all(funds, tables, made)


LINK_SQL = """
SELECT s_nationkey AS doc, s_suppkey AS fund, "table" FROM supplier JOIN (SELECT DISTINCT c_nationkey, c_mktsegment AS "table" FROM customer) ON s_nationkey = c_nationkey
WHERE (s_nationkey, s_suppkey, "table") NOT IN (SELECT c_nationkey, c_custkey % 50, c_mktsegment FROM customer)
"""


def unsearched_pages(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("user_id").alias("field"), F.dayofyear("ts").cast("long").alias("page"), "event_type")
    out = planning.unsearched(e.select("field", "page"), e.where("event_type = 'click'").select("field", "page"))
    return out.select("field", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


UNSEARCHED_SQL = """
WITH k AS (SELECT DISTINCT user_id AS field, CAST(dayofyear(ts) AS BIGINT) AS page FROM events
  WHERE (user_id, dayofyear(ts)) NOT IN (SELECT user_id, dayofyear(ts) FROM events WHERE event_type = 'click')),
t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY field ORDER BY page) <= 15)
SELECT field, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM t GROUP BY field
"""

def _brand_tables(spark, sf):
    """Parts of a brand as a fund's classes (with an end to every other name) and as its table of codes."""
    p = read_table(spark, sf, "part")
    classes = p.select(
        F.col("p_brand").alias("fund"), F.col("p_partkey").alias("ord"),
        F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("")).alias("name"),
        F.when(F.col("p_size") > 40, F.col("p_type")).otherwise("NOT_FOUND").alias("isin"),
    )
    words = F.split("p_name", " ")
    row = F.array(F.array_join(F.reverse(words), " "), F.col("p_type"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("XX"), F.col("p_partkey").cast("string"))).otherwise(""))
    tables = p.where("p_size <= 25").groupBy(F.col("p_brand").alias("fund")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("t"))
    odd = F.length("fund") % 2 == 1
    columns = F.when(odd, F.array(*map(F.lit, ("share class ", "Type", "ISIN")))).otherwise(F.array(*map(F.lit, ("Classes", "Type", "ISIN Code"))))
    hint = F.when(odd, F.lit(None).cast("string")).otherwise("Fund Name")
    return classes, tables.select("fund", hint.alias("hint"), columns.alias("columns"), F.transform("t", lambda x: x["r"]).alias("rows"))


def class_codes_from_tables(spark, sf):
    classes, tables = _brand_tables(spark, sf)
    return enrichment.fill_from_tables(classes, tables, "isin", enrichment.CODE_COLUMNS)


def broadcast_rows_alike(spark, sf):
    """Customers' balances as rows of consolidated tables that name nations behind an umbrella."""
    n, c = read_table(spark, sf, "nation"), read_table(spark, sf, "customer")
    classes = n.select(F.concat(F.lit("Fund "), F.reverse("n_name"), "n_name").alias("fund"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord"))
    classes = classes.select("fund", "ord", F.concat(F.lit("Class "), (F.col("ord") % 3).cast("string")).alias("class"), F.lit("NOT_FOUND").alias("fee"))
    named = F.concat(F.lit("UMBRELLA - fund-"), F.reverse("n_name"), "n_name")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        named.alias("fund"), F.concat(F.lit("Class "), (F.col("c_custkey") % 4).cast("string")).alias("class"), F.col("c_custkey").alias("ord"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("NOT_FOUND").alias("fee"),
    )
    return enrichment.apply_rows_alike(classes, rows, ["fee"], 1.0)


ALIKE_ROWS_SQL = """
WITH f AS (SELECT n_nationkey AS k, 'Fund ' || reverse(n_name) || n_name AS fund FROM nation),
c AS (SELECT k, fund, unnest([0, 1, 2, 3])::INTEGER AS ord FROM f),
r AS (SELECT c_nationkey AS k, c_custkey % 4 AS class, arg_max(c_mktsegment, c_custkey) AS fee FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2)
SELECT fund, ord, 'Class ' || (ord % 3) AS class, CASE WHEN ord < 3 AND r.fee IS NOT NULL THEN r.fee ELSE 'NOT_FOUND' END AS fee
FROM c LEFT JOIN r ON r.k = c.k AND r.class = ord % 3
"""


def umbrella_page_guard(spark, sf):
    """Orders' days as planned pages of a customer and quarters of them as noted ones, in documents of 20 to 300 pages."""
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    held = o.groupBy(F.col("o_custkey").alias("doc")).agg(
        F.array_sort(F.collect_list(F.when(F.col("o_custkey") % 3 > 0, k % 40 + 1))).alias("planned"), F.collect_list(F.when(F.col("o_custkey") % 4 > 0, k % 90 + 1)).alias("noted")
    )
    pages = planning.umbrella_pages(F.col("planned"), F.col("noted"), F.col("doc") % 281 + 20, 8, 3, 5)
    return held.select("doc", F.array_join(pages, ",").alias("pages"))


UMBRELLA_SQL = """
WITH o AS (
  SELECT o_custkey AS doc, coalesce(list_sort(list(o_orderkey % 40 + 1) FILTER (o_custkey % 3 > 0)), []) AS plan,
    coalesce(list_sort(list(DISTINCT o_orderkey % 90 + 1) FILTER (o_custkey % 4 > 0)), []) AS notes, o_custkey % 281 + 20 AS n
  FROM orders GROUP BY 1
)
SELECT doc, array_to_string(CASE
  WHEN len(plan) BETWEEN 1 AND 8 AND len(plan) < n * 0.9 AND plan[-1] - plan[1] + 1 <= n * 0.8 THEN plan
  WHEN len(notes) > 8 THEN list_concat(notes[1:3], notes[-5:]) WHEN len(notes) > 0 THEN notes
  ELSE list_concat(range(1, least(3, n) + 1), range(greatest(n - 5 + 1, 4), n + 1)) END, ',') AS pages
FROM o
"""


def plan_names(spark, sf):
    """Suppliers as tasks of a plan for each nation, under the name of the first supplier of their balance's hundred."""
    s = read_table(spark, sf, "supplier")
    group = F.floor(F.col("s_acctbal") / 1000)
    first = s.groupBy(F.col("s_nationkey").alias("doc"), group.alias("g")).agg(F.min("s_name").alias("canonical"))
    names = s.where(F.col("s_suppkey") % 5 > 0).select(F.col("s_nationkey").alias("doc"), group.alias("g"), F.col("s_name").alias("name")).join(first, ["doc", "g"])
    tasks = s.select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("fund"), F.col("s_acctbal").alias("pages"))
    return planning.normal_plan(tasks, names.select("doc", "name", "canonical"))


PLAN_NAMES_SQL = """
WITH f AS (SELECT s_nationkey AS doc, floor(s_acctbal / 1000) AS g, min(s_name) AS canonical FROM supplier GROUP BY 1, 2)
SELECT s_nationkey AS doc, s_suppkey AS ord, CASE WHEN s_suppkey % 5 > 0 THEN canonical ELSE s_name END AS fund, s_acctbal AS pages
FROM supplier JOIN f ON doc = s_nationkey AND g = floor(s_acctbal / 1000)
QUALIFY row_number() OVER (PARTITION BY s_nationkey, CASE WHEN s_suppkey % 5 > 0 THEN canonical ELSE s_name END ORDER BY s_suppkey) = 1
"""


QUERIES = {
    "umbrella_page_guard": (umbrella_page_guard, UMBRELLA_SQL),
    "plan_names": (plan_names, PLAN_NAMES_SQL),
    "class_codes_from_tables": (class_codes_from_tables, None),
    "broadcast_rows_alike": (broadcast_rows_alike, ALIKE_ROWS_SQL),
    "mention_ranges": (mention_ranges, RANGES_SQL),
    "toc_children": (toc_children, CHILDREN_SQL),
    "page_range_sources": (page_range_sources, SOURCES_SQL),
    "location_logic": (location_logic, LOCATION_SQL),
    "extraction_recipes": (extraction_recipes, RECIPES_SQL),
    "reference_resolver": (reference_resolver, REFERENCE_SQL),
    "class_merge": (class_merge, CLASS_SQL),
    "class_constraints": (class_constraints, CONSTRAINTS_SQL),
    "missing_reasons": (missing_reasons, REASONS_SQL),
    "error_rollup": (error_rollup, ERRORS_SQL),
    "graph_stats": (graph_stats, STATS_SQL),
    "critic_scores": (critic_scores, CRITIC_SQL),
    "link_funds_to_tables": (link_funds_to_tables, LINK_SQL),
    "unsearched_pages": (unsearched_pages, UNSEARCHED_SQL),
}
