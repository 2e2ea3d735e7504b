"""Queries over entities, relations, facts, names, costs and nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.similarity import matcher_ratio
from leafmill.functions.values import is_not_found, raw_value, tier
from leafmill.operators import assembly, graph, resolve
from leafmill.session import in_job, materialize, parts, read_table, scratch_path, ship_code
from leafmill.sources import triples
from leafmill.streaming import store


def graph_upsert(spark, sf):
    """Events as writes to user entities."""
    e = read_table(spark, sf, "events")
    writes = e.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.array(F.dayofyear("ts")).alias("pages"),
        F.col("value").alias("confidence"), F.col("event_type").alias("name"), F.col("props").alias("phase"), F.col("event_id").alias("ord"),
    )
    out = graph.upsert(writes)
    return out.withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ","))


UPSERT_SQL = """
WITH e AS (SELECT 'user:' || CAST(user_id AS VARCHAR) AS key, dayofyear(ts) AS page, * FROM events),
p AS (SELECT key, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM (SELECT DISTINCT key, page FROM e) GROUP BY key),
s AS (SELECT key, max(value) AS confidence, arg_max(event_type, event_id) AS name, arg_min(props, event_id) AS phase, count(*) AS n_writes FROM e GROUP BY key)
SELECT * FROM p JOIN s USING (key)
"""


def _notes(spark, sf):
    """Events as notes of one document a user: views name funds, purchases and clicks tables."""
    e = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    fund = F.concat(F.lit("F"), (k % 40).cast("string"))
    told = e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("ord"), "event_type", k.alias("k"), fund.alias("fund"), F.array(F.dayofyear("ts")).alias("pages"))
    funds = told.where("event_type = 'view'").select("doc", "ord", graph.keyed(F.col("fund")).alias("key"))
    kind = F.when(F.col("k") % 2 == 0, "isin").otherwise("fee")
    tables = told.where("event_type in ('purchase', 'click')").select(
        "doc", "ord", kind.alias("kind"), "pages", (F.col("event_type") == "purchase").alias("consolidated"), "fund"
    )
    return funds, graph.recorded_tables(tables)


def table_links(spark, sf):
    return graph.table_links(*_notes(spark, sf))


LINKS_SQL = """
WITH e AS (SELECT user_id AS doc, event_id AS ord, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, dayofyear(ts) AS page FROM events),
f AS (SELECT doc, 'fund:F' || (k % 40) AS subject, min(ord) AS first FROM e WHERE event_type = 'view' GROUP BY 1, 2),
t AS (
  SELECT doc, ord, event_type, k, CASE WHEN k % 2 = 0 THEN 'has_isin_in' ELSE 'has_fee_in' END AS type,
    'table:' || CASE WHEN k % 2 = 0 THEN 'isin_' ELSE 'fee_' END || page AS object
  FROM e WHERE event_type IN ('purchase', 'click')
)
SELECT doc, type, subject, object, min(ord) AS ord FROM (
  SELECT t.doc, type, subject, object, ord FROM t JOIN f ON f.doc = t.doc AND f.first < t.ord WHERE event_type = 'purchase'
  UNION ALL SELECT doc, type, 'fund:F' || (k % 40), object, ord FROM t WHERE event_type = 'click')
GROUP BY 1, 2, 3, 4
"""


def store_upsert(spark, sf):
    """Events as two batches of writes merged into a stored table, the second one twice."""
    e = read_table(spark, sf, "events").select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.dayofyear("ts").alias("page"), "value", "event_type", "event_id"
    )

    def work():
        path = scratch_path(spark, "store")
        for number, kinds in ((1, ("view", "signup")), (2, ("click", "error", "purchase")), (2, ("click", "error", "purchase"))):
            writes = e.where(F.col("event_type").isin(*kinds)).groupBy("key").agg(
                F.array_sort(F.collect_set("page")).alias("pages"), F.max("value").alias("confidence"), F.max_by("event_type", "event_id").alias("name"),
                F.max("event_id").alias("ord"), F.count(F.lit(1)).alias("n_writes"),
            )
            store.merge_batch(writes, number, path, ("key",), store.entity_rows, 32)
        return store.stored(spark, path, writes).withColumn("pages", F.array_join("pages", ","))

    return in_job("stored", work)


STORE_SQL = """
SELECT 'user:' || user_id AS key, array_to_string(list_sort(list_distinct(list(dayofyear(ts)))), ',') AS pages, max(value) AS confidence,
  arg_max(event_type, event_id) AS name, max(event_id) AS ord, count(*) AS n_writes FROM events GROUP BY 1
"""


def _edges(spark, sf):
    l = read_table(spark, sf, "lineitem")
    return l.select(
        F.col("l_returnflag").alias("type"), F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object"),
        F.col("l_discount").alias("confidence"), F.col("l_linestatus").alias("property"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def relation_merge(spark, sf):
    """Part-supplier edges by the insert path; the driver's keys may repeat, so the last property is the largest of the last."""
    e = _edges(spark, sf).groupBy("type", "subject", "object", "ord").agg(F.max("confidence").alias("confidence"), F.max("property").alias("property"))
    return graph.merge_relations(e)


def relation_dedupe(spark, sf):
    """The same edges by the rename path: the first stays."""
    e = _edges(spark, sf).groupBy("type", "subject", "object", "ord").agg(F.max("confidence").alias("confidence"), F.max("property").alias("property"))
    return graph.first_relations(e)


EDGES_SQL = """
SELECT l_returnflag AS type, l_suppkey AS subject, l_partkey AS object, l_orderkey * 10 + l_linenumber AS ord,
  max(l_discount) AS confidence, max(l_linestatus) AS property FROM lineitem GROUP BY 1, 2, 3, 4
"""
MERGE_SQL = f"""
SELECT type, subject, object, max(confidence) AS confidence, arg_max(property, ord) AS property, min(ord) AS ord, count(*) AS n_writes
FROM ({EDGES_SQL}) GROUP BY 1, 2, 3
"""
DEDUPE_SQL = f"SELECT * FROM ({EDGES_SQL}) QUALIFY row_number() OVER (PARTITION BY type, subject, object ORDER BY ord) = 1"


def entity_rename(spark, sf):
    """Customers renamed to the first customer of their nation and segment."""
    c = read_table(spark, sf, "customer")
    key = F.concat(F.lit("fund:"), F.col("c_name"))
    entities = c.select(key.alias("key"), F.array("c_nationkey").alias("pages"), F.col("c_acctbal").alias("confidence"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("phase"), F.col("c_custkey").alias("ord"))
    first = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min_by("c_name", "c_custkey").alias("canonical"))
    names = c.join(first, ["c_nationkey", "c_mktsegment"]).where("c_custkey % 4 <> 0").select(key.alias("key"), graph.keyed(F.col("canonical")).alias("canonical"))
    out = graph.rename(entities, names)
    return out.withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ","))


RENAME_SQL = """
WITH f AS (SELECT c_nationkey, c_mktsegment, arg_min(c_name, c_custkey) AS canonical FROM customer GROUP BY 1, 2),
m AS (SELECT c.*, 'fund:' || CASE WHEN c_custkey % 4 <> 0 THEN canonical ELSE c_name END AS key FROM customer c JOIN f USING (c_nationkey, c_mktsegment))
SELECT key, (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT unnest(list_distinct(list(c_nationkey))) AS x)) AS pages,
  max(c_acctbal) AS confidence, arg_min(c_name, c_custkey) AS name, arg_min(c_mktsegment, c_custkey) AS phase, count(*) AS n_writes FROM m GROUP BY key
"""


def relation_rekey(spark, sf):
    """Orders as relations between customers and sections, customers renamed to the first of their nation and segment."""
    c, o = read_table(spark, sf, "customer"), read_table(spark, sf, "orders")
    first = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min_by("c_name", "c_custkey").alias("canonical"))
    names = c.join(first, ["c_nationkey", "c_mktsegment"]).where("c_custkey % 4 <> 0").select(graph.keyed(F.col("c_name")).alias("key"), graph.keyed(F.col("canonical")).alias("canonical"))
    told = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.when(F.col("o_orderkey") % 2 == 0, "references").otherwise("part_of").alias("type"),
        F.when(F.col("o_orderkey") % 3 == 0, graph.keyed(F.col("o_orderstatus"), "section")).otherwise(graph.keyed(F.col("c_name"))).alias("subject"),
        F.when(F.col("o_orderkey") % 3 == 0, graph.keyed(F.col("c_name"))).otherwise(graph.keyed(F.col("o_orderpriority"), "section")).alias("object"),
        F.col("o_orderkey").alias("ord"),
    )
    return graph.rekey_relations(told, names)


REKEY_SQL = """
WITH f AS (SELECT c_nationkey, c_mktsegment, arg_min(c_name, c_custkey) AS canonical FROM customer GROUP BY 1, 2),
m AS (SELECT c_custkey, 'fund:' || CASE WHEN c_custkey % 4 <> 0 THEN canonical ELSE c_name END AS key FROM customer JOIN f USING (c_nationkey, c_mktsegment)),
r AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'references' ELSE 'part_of' END AS type, CASE WHEN o_orderkey % 3 = 0 THEN 'section:' || o_orderstatus ELSE key END AS subject,
  CASE WHEN o_orderkey % 3 = 0 THEN key ELSE 'section:' || o_orderpriority END AS object, o_orderkey AS ord FROM orders JOIN m ON o_custkey = c_custkey)
SELECT type, subject, object, min(ord) AS ord FROM r GROUP BY 1, 2, 3
"""


def fund_context_hints(spark, sf):
    """Customers as funds: their first urgent order as a table hint, other orders as facts."""
    c, o = read_table(spark, sf, "customer"), read_table(spark, sf, "orders")
    funds = c.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("n_pages"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    hints = o.where(urgent & (F.col("o_totalprice") > 100_000)).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("table_id"), F.col("o_orderkey").alias("ord"))
    return graph.contexts(funds, hints, o.where(~urgent & (F.col("o_orderstatus") == "F")).select(F.col("o_custkey").alias("key")))


CONTEXT_SQL = """
WITH h AS (SELECT o_custkey AS key, min(o_orderkey) AS table_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000 GROUP BY 1),
f AS (SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS key, CAST(c_nationkey AS BIGINT) AS n_pages, table_id, coalesce(n, 0) AS n_facts,
  CAST(CASE WHEN table_id IS NOT NULL THEN 0.9 WHEN n > 0 THEN 0.8 WHEN c_nationkey > 0 THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence
FROM customer LEFT JOIN h ON h.key = c_custkey LEFT JOIN f ON f.key = c_custkey
"""


def orphan_anti_join(spark, sf):
    """Orders without a customer among those who owe nothing, and such customers without an order."""
    c = read_table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("key"))
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("fact"))
    lost = graph.orphans(o, c).select(F.lit("orphan").alias("issue"), "key", "fact")
    empty = graph.bare(c, o).select(F.lit("bare").alias("issue"), "key", F.lit(None).cast("long").alias("fact"))
    return lost.unionByName(empty)


def _supplied(spark, sf):
    l = read_table(spark, sf, "lineitem")
    ends = l.select(F.col("l_partkey").alias("subject"), F.concat(F.lit("supplied_"), "l_returnflag").alias("type"), F.col("l_suppkey").alias("object"))
    return ends.groupBy("subject", "type", "object").agg(F.count(F.lit(1)).alias("n"))


def relation_patterns(spark, sf):
    """The relations of parts and suppliers that each of the eight patterns over the first relation's ends finds."""

    def work():
        store = triples.write(_supplied(spark, sf), int(spark.conf.get("spark.sql.shuffle.partitions")))
        first = store.query().agg(F.min(F.struct("subject", "type", "object")).alias("x")).first()["x"]
        out = None
        for k in range(8):
            ends = [first[e] if first and k >> i & 1 else None for i, e in enumerate(triples.ENDS)]
            found = store.query(*ends).select(F.lit(k).alias("pattern"), "subject", "type", "object", "n")
            out = found if out is None else out.unionByName(found)
        return out

    return in_job("patterns", work)


PATTERNS_SQL = """
WITH e AS (SELECT l_partkey AS subject, 'supplied_' || l_returnflag AS type, l_suppkey AS object, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT * FROM e ORDER BY subject, type, object LIMIT 1), k AS (SELECT unnest(range(8))::INTEGER AS pattern)
SELECT pattern, e.subject, e.type, e.object, e.n FROM e, f, k
WHERE (pattern & 1 = 0 OR e.subject = f.subject) AND (pattern & 2 = 0 OR e.type = f.type) AND (pattern & 4 = 0 OR e.object = f.object)
"""


ORPHAN_SQL = """
WITH c AS (SELECT c_custkey AS key FROM customer WHERE c_acctbal >= 0)
SELECT 'orphan' AS issue, o_custkey AS key, o_orderkey AS fact FROM orders WHERE o_custkey NOT IN (SELECT key FROM c)
UNION ALL SELECT 'bare', key, NULL FROM c WHERE key NOT IN (SELECT o_custkey FROM orders)
"""


def _facts(spark, sf):
    e = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    source = F.element_at(F.array(*map(F.lit, ("toc", "table", "section", "body_text", "inferred", "unknown"))), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("event_id").alias("ord"), (k % 4).cast("string").alias("value"),
        (k % 10 / 10).alias("confidence"), F.dayofyear("ts").cast("long").alias("page"), source.alias("source"),
    )


def fact_conflict_fold(spark, sf):
    return resolve.fold_facts(_facts(spark, sf))


FACTS_SQL = """
SELECT user_id AS key, event_type AS field, event_id AS ord, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS VARCHAR) AS value,
  (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) / 10 AS confidence, CAST(dayofyear(ts) AS BIGINT) AS page,
  CAST([1.0, 0.9, 0.8, 0.6, 0.4, 0.3][event_id % 6 + 1] AS DOUBLE) AS rank FROM events
"""
FOLD_SQL = f"""
WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY ord) AS n FROM ({FACTS_SQL})),
r AS (
  SELECT key, field, n, value, confidence, page, rank, 0::BIGINT AS c1, 0::BIGINT AS c2, 0::BIGINT AS c3, 0::BIGINT AS c4 FROM f WHERE n = 1
  UNION ALL
  SELECT key, field, n, CASE WHEN take THEN v ELSE value END, CASE WHEN take THEN greatest(c, confidence) ELSE confidence END, CASE WHEN take THEN p ELSE page END, rank,
    c1 + CASE WHEN NOT same AND why = 1 THEN 1 ELSE 0 END, c2 + CASE WHEN NOT same AND why = 2 THEN 1 ELSE 0 END,
    c3 + CASE WHEN NOT same AND why = 3 THEN 1 ELSE 0 END, c4 + CASE WHEN NOT same AND why = 4 THEN 1 ELSE 0 END
  FROM (
    SELECT *, CASE WHEN same THEN c > confidence WHEN why = 1 THEN c > confidence WHEN why = 2 THEN k > rank ELSE true END AS take FROM (
      SELECT r.key, r.field, f.n, r.value, r.confidence, r.page, r.rank, r.c1, r.c2, r.c3, r.c4, f.value AS v, f.confidence AS c, f.page AS p, f.rank AS k,
        f.value = r.value AS same,
        CASE WHEN abs(f.confidence - r.confidence) > 0.3::DOUBLE THEN 1 WHEN abs(f.rank - r.rank) > 0.15::DOUBLE THEN 2 WHEN f.page > r.page + 10 THEN 3 ELSE 4 END AS why
      FROM r JOIN f ON f.key = r.key AND f.field = r.field AND f.n = r.n + 1))
)
SELECT key, field, value, confidence, page, c1 + c2 + c3 + c4 AS n_conflicts, c1 AS by_confidence, c2 AS by_source, c3 AS by_page, c4 AS by_default
FROM r QUALIFY row_number() OVER (PARTITION BY key, field ORDER BY n DESC) = 1
"""


def fact_conflicts(spark, sf):
    return assembly.conflicts(_facts(spark, sf))


CONFLICTS_SQL = f"SELECT key, field, count(DISTINCT value) AS n_values FROM ({FACTS_SQL}) GROUP BY 1, 2 HAVING count(DISTINCT value) > 1"


def cluster_confidence(spark, sf):
    """Conversations as clusters of mentions."""
    c = read_table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("mentions"), F.count_distinct("role").alias("chunks"), F.bool_or(F.col("role") == "system").alias("system"),
        F.min_by("text", F.struct("turn", "role", "text")).alias("text"), F.max(F.length("text")).alias("longest"),
    )
    name = F.substring(F.col("text"), F.lit(1), (F.col("conv_id") % 20 + 4).cast("int"))
    sure = resolve.cluster_confidence(F.col("conv_id") % 3 == 0, F.col("system"), F.col("longest") > 1000, F.col("mentions"), F.col("chunks"), name)
    return c.select("conv_id", F.round(sure, 6).alias("confidence")).where("confidence >= 0.4")


CLUSTER_SQL = """
WITH c AS (SELECT conv_id, count(*) AS mentions, count(DISTINCT role) AS chunks, bool_or(role = 'system') AS system, first(text ORDER BY turn, role, text) AS text, max(length(text)) AS longest FROM conversations GROUP BY 1),
n AS (SELECT *, text[1:CAST(conv_id % 20 + 4 AS INTEGER)] AS name, conv_id % 3 = 0 AS toc FROM c),
s AS (SELECT conv_id, CASE WHEN toc THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN system THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN longest > 1000 THEN 0.15::DOUBLE ELSE 0 END
  + least(0.1::DOUBLE, greatest(0, mentions - 1) * 0.05::DOUBLE) + CASE WHEN chunks > 1 THEN 0.05::DOUBLE ELSE 0 END
  - CASE WHEN NOT toc AND length(name) < 20 AND NOT contains(lower(name), 'fund') THEN 0.2::DOUBLE ELSE 0 END
  - CASE WHEN NOT toc AND regexp_full_match(replace(name, ' ', ''), '[\\p{L}\\p{N}]+') AND length(name) < 10 THEN 0.3::DOUBLE ELSE 0 END AS x FROM n)
SELECT conv_id, round(least(1, greatest(0, x)), 6) AS confidence FROM s WHERE round(least(1, greatest(0, x)), 6) >= 0.4
"""


def cost_by_agent(spark, sf):
    """Conversation turns as model calls: a token is four characters."""
    c = read_table(spark, sf, "conversations")
    tokens = F.expr("length(text) div 4")
    calls = c.select(
        F.when(F.col("role") == "system", "").otherwise(F.col("role")).alias("agent"),
        F.when(F.col("turn") % 3 == 0, "openrouter/big").when(F.col("turn") % 3 == 1, "small").otherwise("other").alias("model"),
        tokens.alias("prompt_tokens"), (tokens * 2).alias("completion_tokens"),
    )
    prices = spark.createDataFrame([("big", 2.5, 10.0), ("small", 0.15, 0.6)], "model string, rate_in double, rate_out double")
    return assembly.costs(calls, prices)


COST_SQL = """
WITH c AS (SELECT CASE WHEN role = 'system' THEN 'unknown' ELSE role END AS agent, turn % 3 AS m, length(text) // 4 AS p FROM conversations)
SELECT agent, count(*) AS n_calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(p * 2) AS BIGINT) AS completion_tokens,
  round(sum(CASE m WHEN 0 THEN (p * 2.5::DOUBLE + p * 2 * 10.0::DOUBLE) / 1e6::DOUBLE WHEN 1 THEN (p * 0.15::DOUBLE + p * 2 * 0.6::DOUBLE) / 1e6::DOUBLE ELSE 0::DOUBLE END), 6) AS cost
FROM c GROUP BY ROLLUP (agent)
"""


def provenance_counts(spark, sf):
    """Event values as extracted values, counted by type."""
    e = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    reason = F.element_at(F.array(*map(F.lit, ("not_in_document", "not_applicable", "in_external_doc", "inherited", "extraction_failed"))), (k % 5 + 1).cast("int"))
    gone = k % 4 == 0
    values = e.select(
        "event_type", F.when(gone, "NOT_FOUND").when(k % 4 == 1, F.lit("")).otherwise(F.col("props")).alias("value"),
        (F.col("event_id") % 11 / 10).alias("confidence"), F.when(gone & (k % 7 != 0), reason).alias("not_found_reason"),
    )
    return assembly.provenance(values, "event_type")


PROVENANCE_SQL = """
WITH v AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 11 / 10 AS sure FROM events),
r AS (SELECT *, k % 4 = 0 AS gone, CASE WHEN k % 4 = 0 AND k % 7 <> 0 THEN ['not_in_document', 'not_applicable', 'in_external_doc', 'inherited', 'extraction_failed'][k % 5 + 1] END AS reason FROM v)
SELECT event_type, count(*) AS n_total, count_if(NOT gone AND sure >= 0.8) AS n_high, count_if(NOT gone AND sure < 0.5) AS n_low, count_if(gone) AS n_not_found,
  count_if(reason = 'not_in_document') AS n_not_in_document, count_if(reason = 'not_applicable') AS n_not_applicable, count_if(reason = 'in_external_doc') AS n_in_external_doc,
  count_if(reason = 'inherited') AS n_inherited, count_if(reason = 'extraction_failed') AS n_extraction_failed,
  count_if(gone AND (reason IS NULL OR reason = 'extraction_failed')) AS n_actionable FROM r GROUP BY 1
"""


def variant_states(spark, sf):
    """The missing states of values whose type isn't fixed: struct, plain, mark and JSON null."""
    e = read_table(spark, sf, "events")
    m = F.col("event_id") % 8
    text = (
        F.when(m == 0, "null").when(m == 1, '"NOT_FOUND"').when(m == 2, '{"value": "NOT_FOUND"}').when(m == 3, F.col("props"))
        .when(m == 4, '""').when(m == 5, "0").when(m == 6, F.concat(F.lit('{"value": "'), "event_type", F.lit('"}')))
    )
    v = e.select("event_id", F.try_parse_json(text).alias("v"), m.alias("m"))
    return v.select("event_id", is_not_found(F.col("v")).alias("missing"), F.when(m != 3, raw_value(F.col("v"), F.lit("-"))).alias("raw"))


VARIANT_SQL = """
SELECT event_id, event_id % 8 IN (0, 1, 2, 7) AS missing,
  CASE event_id % 8 WHEN 0 THEN '-' WHEN 7 THEN '-' WHEN 1 THEN 'NOT_FOUND' WHEN 2 THEN 'NOT_FOUND' WHEN 4 THEN '' WHEN 5 THEN '0' WHEN 6 THEN event_type END AS raw FROM events
"""


def reconciliation_issues(spark, sf):
    """Checks over orders: declared against summed prices, customers without orders, missing parts."""
    o, l, c = (read_table(spark, sf, x) for x in ("orders", "lineitem", "customer"))
    n = parts(o, l, c)

    def issues():
        # Rows are dealt by key in parts of like size before they are counted, so no task holds more keys as tables grow.
        items = l.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_discount") > 0.05).alias("off")).repartition(n, "o_orderkey")
        sums = items.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_items"), F.count_if("off").alias("n_off"))
        j = o.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey").join(sums, "o_orderkey", "left")
        j = materialize(j.withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long"))), "orders")  # read twice, joined once
        issue = F.when(F.col("n_items") > 6, "many_items").when(F.col("n_items") == 0, "no_items")
        a = j.select(issue.alias("issue"), F.col("o_orderkey").alias("id"), "n_items").where("issue is not null")
        by = j.select("o_custkey", (F.col("n_off") > 0.3 * F.col("n_items")).alias("off")).repartition(n, "o_custkey")
        by = by.groupBy("o_custkey").agg(F.count_if("off").alias("n_items"))
        d = by.where("n_items > 3").select(F.lit("often_off").alias("issue"), F.col("o_custkey").alias("id"), "n_items")
        e = c.select("c_custkey").repartition(n, "c_custkey").join(by, c["c_custkey"] == by["o_custkey"], "left_anti")
        e = e.select(F.lit("no_orders").alias("issue"), F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("n_items"))
        return a.unionByName(d).unionByName(e)

    return in_job("issues", issues)


RECONCILE_SQL = """
WITH s AS (SELECT l_orderkey, count(*) AS n, count_if(l_discount > 0.05) AS off FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, o_custkey, coalesce(n, 0) AS n_items, off FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT 'many_items' AS issue, o_orderkey AS id, n_items FROM j WHERE n_items > 6
UNION ALL SELECT 'no_items', o_orderkey, n_items FROM j WHERE n_items = 0
UNION ALL SELECT 'often_off', o_custkey, count(*) FROM j WHERE off > 0.3 * n_items GROUP BY 2 HAVING count(*) > 3
UNION ALL SELECT 'no_orders', c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
"""


def nested_graph_json(spark, sf):
    """Region, nation and customer as one nested JSON document a region, read back and compared leaf by leaf."""
    r, n, c = (read_table(spark, sf, x) for x in ("region", "nation", "customer"))
    nations = assembly.nested(
        n.select("n_nationkey", "n_regionkey", "n_name", F.col("n_nationkey").alias("ord")),
        c.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("ord"), "c_name", "c_acctbal"), "n_nationkey", "classes",
    )
    regions = assembly.nested(
        r.select("r_regionkey", "r_name"), nations.select(F.col("n_regionkey").alias("r_regionkey"), "ord", "n_name", "classes"), "r_regionkey", "funds"
    )
    doc = regions.select("r_regionkey", F.to_json(F.struct("r_name", "funds")).alias("json"))
    back = "r_name string, funds array<struct<n_name: string, classes: array<struct<c_name: string, c_acctbal: double>>>>"
    tree = doc.select("r_regionkey", F.from_json("json", back).alias("d"))
    flat = tree.select(F.col("d.r_name").alias("r_name"), F.posexplode("d.funds").alias("fund", "f"))
    return flat.select("r_name", "fund", F.col("f.n_name").alias("n_name"), F.posexplode("f.classes").alias("class", "c")).select(
        "r_name", "fund", "n_name", "class", "c.c_name", "c.c_acctbal", tier(F.col("c.c_acctbal") / 10_000).alias("tier")
    )


NESTED_SQL = """
SELECT r_name, CAST(dense_rank() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS fund, n_name,
  CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS class, c_name, c_acctbal,
  CASE WHEN c_acctbal / 10000 >= 0.8 THEN 'high' WHEN c_acctbal / 10000 >= 0.5 THEN 'medium' ELSE 'low' END AS tier
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
"""


def _tables_of_parts(spark, sf):
    """(doc, name, ord): parts as rows of tables, a hundred keys a table, so that tables grow in number only."""
    p = read_table(spark, sf, "part")
    return p.select(F.expr("p_partkey div 100").alias("doc"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))


def fuzzy_column_row_lookup(spark, sf):
    """Each name of a table looked up among the table's other names: the most alike by sorted words, from 80 on."""
    p = _tables_of_parts(spark, sf).groupBy("doc", "name").agg(F.min("ord").alias("ord"))
    rows = p.select("doc", F.col("name").alias("cell"), F.col("ord").alias("other"))
    return resolve.best_rows(p.select("doc", "name"), rows.where("cell <> ''"), 80.0)


def toc_match_fuzzy(spark, sf):
    """Nations' names with a slip, found among the nations of their region."""
    n = read_table(spark, sf, "nation")
    used = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    slip = F.concat(F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise(""))
    names = n.join(used, "n_nationkey", "left_semi").select(F.col("n_regionkey").alias("doc"), slip.alias("name"))
    return resolve.best_name(names, n.select(F.col("n_regionkey").alias("doc"), F.col("n_name").alias("toc_name"), F.col("n_nationkey").alias("ord")))


def greedy_cluster(spark, sf):
    """Part names clustered inside each table, in order of key."""
    return resolve.greedy_clusters(_tables_of_parts(spark, sf))


def _merged(names):
    bare = names.withColumns({"page": F.lit(None).cast("int"), "confidence": F.lit(0.5), "properties": F.create_map().cast("map<string,string>")})
    return in_job("merge", lambda: resolve.merge_in_order(bare)[0])


def incremental_merge(spark, sf):
    """Names of parts merged one by one inside each table."""
    return _merged(_tables_of_parts(spark, sf))


def _titles(spark, sf):
    """(doc, name, ord): the first four words of every document, all in one group."""
    d = read_table(spark, sf, "documents").where("doc_id is not null")
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), 1), 1, 4)
    return d.groupBy("doc_id").agg(F.min(F.array_join(words, " ")).alias("name")).select(F.lit(0).alias("doc"), "name", F.col("doc_id").alias("ord"))


def greedy_cluster_whole(spark, sf):
    """Titles of all documents clustered as one group, in order of id."""
    return resolve.greedy_clusters(_titles(spark, sf)).drop("doc")


def entity_merge_whole(spark, sf):
    """Titles of all documents merged into entities one by one: what each entity knows in the end."""
    d = read_table(spark, sf, "documents").groupBy("doc_id").agg(
        F.min("source").alias("source"), F.min("lang").alias("lang"), (F.min("n_chars") % 97).cast("int").alias("page")
    )
    told = _titles(spark, sf).join(d, F.col("ord") == F.col("doc_id"))
    told = told.select(
        "doc", "name", "ord", "page", (F.col("ord") % 10 / 10).alias("confidence"),
        F.map_filter(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang"), lambda k, v: v.isNotNull()).alias("properties"),
    )
    return in_job("entities", lambda: resolve.merge_in_order(told)[1]).drop("doc")


def fund_lookup_fuzzy(spark, sf):
    """The entity that each document's title stands for: labelled documents' titles, first in order of id."""
    titles = _titles(spark, sf)
    labelled = read_table(spark, sf, "labels").select(F.col("doc_id").alias("ord")).distinct()
    entities = titles.join(labelled, "ord", "left_semi").select("doc", F.col("name").alias("entity"), "ord")
    return resolve.first_like(titles, entities).drop("doc")


def model_groups(spark, sf):
    """A model's grouping of part names by brand and size: it left out the names of large parts and set some aside."""
    p = read_table(spark, sf, "part")
    doc = F.expr("p_partkey div 100").alias("doc")
    groups = p.where("p_size <= 35").groupBy(doc, "p_brand").agg(
        F.min_by("p_name", "p_partkey").alias("canonical"), F.collect_set("p_name").alias("variants"), F.min("p_partkey").alias("ord")
    )
    excluded = p.where("p_size > 48").select(doc, F.col("p_name").alias("name")).distinct()
    return resolve.grouped_names(_tables_of_parts(spark, sf), groups, excluded, ["small plated brass"])


def name_ratio(spark, sf):
    """Sequence-matcher ratio of each supplier's name with its nation's."""
    ship_code(spark)
    s, n = read_table(spark, sf, "supplier"), read_table(spark, sf, "nation")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    return j.select("s_suppkey", matcher_ratio(F.lower("s_name"), F.lower("n_name")).alias("ratio"), resolve.names_match(F.col("s_name"), F.col("n_name")).alias("same"))


QUERIES = {
    "graph_upsert": (graph_upsert, UPSERT_SQL),
    "relation_merge": (relation_merge, MERGE_SQL),
    "relation_dedupe": (relation_dedupe, DEDUPE_SQL),
    "entity_rename": (entity_rename, RENAME_SQL),
    "table_links": (table_links, LINKS_SQL),
    "store_upsert": (store_upsert, STORE_SQL),
    "relation_patterns": (relation_patterns, PATTERNS_SQL),
    "relation_rekey": (relation_rekey, REKEY_SQL),
    "fund_context_hints": (fund_context_hints, CONTEXT_SQL),
    "orphan_anti_join": (orphan_anti_join, ORPHAN_SQL),
    "fact_conflict_fold": (fact_conflict_fold, FOLD_SQL),
    "fact_conflicts": (fact_conflicts, CONFLICTS_SQL),
    "cluster_confidence": (cluster_confidence, CLUSTER_SQL),
    "cost_by_agent": (cost_by_agent, COST_SQL),
    "provenance_counts": (provenance_counts, PROVENANCE_SQL),
    "variant_states": (variant_states, VARIANT_SQL),
    "reconciliation_issues": (reconciliation_issues, RECONCILE_SQL),
    "nested_graph_json": (nested_graph_json, NESTED_SQL),
    "fuzzy_column_row_lookup": (fuzzy_column_row_lookup, None),
    "toc_match_fuzzy": (toc_match_fuzzy, None),
    "greedy_cluster": (greedy_cluster, None),
    "incremental_merge": (incremental_merge, None),
    "greedy_cluster_whole": (greedy_cluster_whole, None),
    "entity_merge_whole": (entity_merge_whole, None),
    "fund_lookup_fuzzy": (fund_lookup_fuzzy, None),
    "model_groups": (model_groups, None),
    "name_ratio": (name_ratio, None),
}
