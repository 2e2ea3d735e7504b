"""Queries over sections, ranges, runs, chunks and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as t
from leafmill.functions.json_repair import repaired_json
from leafmill.operators import knowledge, structure
from leafmill.session import read_table


def _sources(spark, sf):
    """Sources as documents, their texts as pages."""
    return read_table(spark, sf, "documents").groupBy(F.col("source").alias("doc")).agg(
        (F.count(F.lit(1)) * (1 + F.length(F.first("source")) % 3) * 3).alias("n_pages")
    )


SOURCES_SQL = "SELECT source AS doc, count(*) * (1 + length(source) % 3) * 3 AS n_pages FROM documents GROUP BY source"


def chunk_fixed_adaptive(spark, sf):
    docs = _sources(spark, sf)
    return structure.fixed_chunks(docs, t.chunk_size(F.col("n_pages")))


CHUNK_SQL = f"""
WITH d AS ({SOURCES_SQL}),
s AS (SELECT *, CASE WHEN n_pages <= 100 THEN 30 WHEN n_pages <= 200 THEN 25 WHEN n_pages <= 350 THEN 20
  WHEN n_pages <= 500 THEN 15 ELSE 10 END AS size FROM d),
e AS (SELECT *, unnest(generate_series(1, n_pages, size)) AS page_start FROM s)
SELECT doc, n_pages, page_start, least(page_start + size - 1, n_pages) AS page_end FROM e
"""


def chunk_overlap(spark, sf):
    return structure.overlapped(chunk_fixed_adaptive(spark, sf))


OVERLAP_SQL = f"""
WITH c AS ({CHUNK_SQL})
SELECT doc, n_pages,
  CASE WHEN row_number() OVER w = 1 THEN page_start ELSE greatest(1, page_start - 5) END AS page_start,
  CASE WHEN lead(page_start) OVER w IS NULL THEN page_end ELSE least(n_pages, page_end + 5) END AS page_end
FROM c WINDOW w AS (PARTITION BY doc ORDER BY page_start)
"""


def _active(spark, sf):
    return read_table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.dayofyear("ts").cast("long").alias("page"))


def first_contiguous_block(spark, sf):
    return structure.runs(_active(spark, sf), "doc").where("run = 1")


RUNS_SQL = """
WITH p AS (SELECT DISTINCT user_id AS doc, CAST(dayofyear(ts) AS BIGINT) AS page FROM events),
i AS (SELECT *, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS island FROM p),
g AS (SELECT doc, min(page) AS page_start, max(page) AS page_end, count(*) AS n_pages FROM i GROUP BY doc, island)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY page_start) AS INTEGER) AS run, page_start, page_end, n_pages FROM g
"""
BLOCK_SQL = f"SELECT * FROM ({RUNS_SQL}) WHERE run = 1"


def contiguous_blocks(spark, sf):
    """Runs written like ``1-3, 50-52``."""
    found = structure.runs(_active(spark, sf), "doc")
    one = F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(
        F.concat_ws("-", F.col("page_start").cast("string"), F.col("page_end").cast("string"))
    )
    told = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("run", one.alias("text")))).alias("x"))
    return told.select("doc", F.array_join(F.transform("x", lambda r: r["text"]), ", ").alias("blocks"))


BLOCKS_SQL = f"""
SELECT doc, string_agg(CASE WHEN page_start = page_end THEN CAST(page_start AS VARCHAR)
  ELSE CAST(page_start AS VARCHAR) || '-' || CAST(page_end AS VARCHAR) END, ', ' ORDER BY run) AS blocks
FROM ({RUNS_SQL}) GROUP BY doc
"""


def uncovered_pages(spark, sf):
    docs = _active(spark, sf).select("doc").distinct().withColumn("n_pages", F.lit(31).cast("long"))
    return structure.uncovered_runs(docs, _active(spark, sf).distinct())


UNCOVERED_SQL = """
WITH u AS (SELECT DISTINCT user_id AS doc FROM events), e AS (SELECT doc, unnest(generate_series(1, 31)) AS page FROM u),
p AS (SELECT doc, page FROM e ANTI JOIN (SELECT DISTINCT user_id AS doc, dayofyear(ts) AS page FROM events) USING (doc, page)),
i AS (SELECT *, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS island FROM p),
g AS (SELECT doc, min(page) AS page_start, max(page) AS page_end, count(*) AS n_pages FROM i GROUP BY doc, island)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY page_start) AS INTEGER) AS run, page_start, page_end, n_pages FROM g
"""


def _toc(spark, sf):
    """Orders of a customer as entries of a table of contents, by day."""
    o = read_table(spark, sf, "orders")
    page = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long") + 1
    return o.select(F.col("o_custkey").alias("doc"), F.struct(page, "o_orderkey").alias("ord"), F.col("o_orderkey").alias("entry"), page.alias("page"))


def section_ranges_lead(spark, sf):
    return structure.sections_from_toc(_toc(spark, sf), "doc", F.lit(4000).cast("long")).drop("ord")


SECTIONS_SQL = """
WITH t AS (SELECT o_custkey AS doc, o_orderkey AS entry, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 1 AS page FROM orders)
SELECT doc, entry, page, coalesce(greatest(page, lead(page) OVER (PARTITION BY doc ORDER BY page, entry) - 1), 4000) AS page_end FROM t
"""


def range_join_sections(spark, sf):
    """Ship dates of line items in the quarter-like sections of a fixed calendar that is derived from order priorities."""
    sections = read_table(spark, sf, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(
        F.min(F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))).cast("long").alias("page_start"),
        F.max(F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))).cast("long").alias("page_end"),
    )
    points = read_table(spark, sf, "lineitem").groupBy(F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n_items"))
    found = structure.in_sections(points, sections, "day")
    return found.groupBy("o_orderpriority", "y").agg(F.sum("n_items").alias("n_items"), F.count(F.lit(1)).alias("n_days"))


RANGE_SQL = """
WITH s AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS y, min(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) AS a,
  max(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) AS b FROM orders GROUP BY 1, 2),
p AS (SELECT date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS d, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderpriority, y, CAST(sum(n) AS BIGINT) AS n_items, count(*) AS n_days FROM s JOIN p ON d BETWEEN a AND b GROUP BY 1, 2
"""


def interval_overlap(spark, sf):
    """Spans of activity of users against spans of event types a week: pairs that share a day."""
    e = read_table(spark, sf, "events")
    day = F.dayofyear("ts").cast("long")
    left = e.groupBy(F.col("user_id")).agg(F.min(day).alias("l_start"), F.max(day).alias("l_end"))
    right = e.groupBy("event_type", F.floor(day / 7).alias("week")).agg(F.min(day).alias("r_start"), F.max(day).alias("r_end"))
    return structure.overlapping(left, right, 8).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_spans"))


OVERLAPS_SQL = """
WITH e AS (SELECT user_id, event_type, CAST(dayofyear(ts) AS BIGINT) AS d FROM events),
l AS (SELECT user_id, min(d) AS a, max(d) AS b FROM e GROUP BY 1),
r AS (SELECT event_type, d // 7 AS week, min(d) AS a, max(d) AS b FROM e GROUP BY 1, 2)
SELECT user_id, count(*) AS n_spans FROM l JOIN r ON l.a <= r.b AND r.a <= l.b GROUP BY 1
"""


def toc_from_html(spark, sf):
    """Links of a page as its contents, in order, with the page's title."""
    pages = read_table(spark, sf, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    entries = pages.select("page_id", F.trim(title).alias("title"), F.posexplode(links).alias("ord", "link"))
    toc = entries.select(F.col("page_id").alias("doc"), "title", "ord", "link", (F.col("ord") * 3 + 1).cast("long").alias("page"))
    return structure.sections_from_toc(toc, "doc", F.lit(100).cast("long"))


TOC_SQL = """
WITH p AS (SELECT page_id AS doc, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
  regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages),
e AS (SELECT doc, title, unnest(l) AS link, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ord FROM p)
SELECT doc, title, ord, link, CAST(ord * 3 + 1 AS BIGINT) AS page,
  coalesce(greatest(CAST(ord * 3 + 1 AS BIGINT), lead(CAST(ord * 3 + 1 AS BIGINT)) OVER (PARTITION BY doc ORDER BY ord) - 1), 100) AS page_end FROM e
"""


def token_budget(spark, sf):
    """Tokens of a plan at 3000 characters a page and four characters a token, and the pages that fit 80,000."""
    docs = _sources(spark, sf)
    tokens = F.expr("n_pages * 3000 div 4")
    pages = structure.first_and_last(F.col("n_pages"))
    return docs.select(
        "doc", "n_pages", tokens.alias("tokens"), (tokens > 80_000).alias("too_long"),
        F.least(F.col("n_pages"), F.lit(80_000 * 4 // 3000)).cast("long").alias("fitting"),
        F.array_join(F.transform(pages, lambda x: x.cast("string")), ",").alias("ends"),
    )


BUDGET_SQL = f"""
WITH d AS ({SOURCES_SQL}), e AS (SELECT doc, n_pages, unnest(generate_series(1, n_pages)) AS p FROM d)
SELECT doc, n_pages, n_pages * 3000 // 4 AS tokens, n_pages * 3000 // 4 > 80000 AS too_long, CAST(least(n_pages, 106) AS BIGINT) AS fitting,
  string_agg(CASE WHEN p <= 5 OR p > n_pages - 15 THEN CAST(p AS VARCHAR) END, ',' ORDER BY p) AS ends
FROM e GROUP BY doc, n_pages
"""


def smart_chunks(spark, sf):
    """Boundary-aware chunks of sources whose sections start where a language does."""
    docs = _sources(spark, sf)
    d = read_table(spark, sf, "documents")
    sections = d.groupBy(F.col("source").alias("doc"), "lang").agg(F.min(F.col("doc_id") % 97 + 1).alias("page_start"), F.max(F.col("doc_id") % 97 + 1).alias("page_end"))
    return structure.smart_chunks(docs, sections)


SMART_SQL = f"""
WITH RECURSIVE d AS ({SOURCES_SQL}),
s AS (SELECT source AS doc, lang, min(doc_id % 97 + 1) AS a, max(doc_id % 97 + 1) AS b FROM documents GROUP BY 1, 2),
b AS (SELECT DISTINCT u.doc, x FROM (SELECT doc, a AS x FROM s UNION ALL SELECT doc, b + 1 FROM s UNION ALL SELECT doc, 1 FROM d UNION ALL SELECT doc, n_pages + 1 FROM d) u
  JOIN d USING (doc) WHERE x BETWEEN 1 AND n_pages + 1),
p AS (SELECT doc, n_pages, unnest(generate_series(1, n_pages)) AS a FROM d),
e AS (SELECT p.doc, p.a, p.n_pages, least(p.n_pages, coalesce(max(x) - 1, p.a + 29)) AS z FROM p LEFT JOIN b ON b.doc = p.doc AND x BETWEEN p.a + 10 AND p.a + 30 GROUP BY p.doc, p.a, p.n_pages),
r AS (SELECT doc, CAST(1 AS BIGINT) AS chunk, a, z FROM e WHERE a = 1 UNION ALL SELECT e.doc, chunk + 1, e.a, e.z FROM r JOIN e ON e.doc = r.doc AND e.a = r.z + 1)
SELECT doc, chunk, a AS page_start, z AS page_end FROM r
"""


def inventory_aggregate(spark, sf):
    """Labels as fields that documents hold: pages, confidence, last table type."""
    d, l = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    present = d.join(l, "doc_id").select(
        F.concat("lang", F.lit(":"), F.col("quality").cast("string")).alias("field"), F.col("doc_id").alias("page"),
        (F.col("n_chars") % 100 / 100).alias("confidence"), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("table_type"),
        F.col("doc_id").alias("ord"),
    )
    found = knowledge.inventory(present)
    return found.select("field", F.size("pages").cast("long").alias("n_pages"), F.element_at("pages", 1).alias("first_page"), "confidence", "table_type", "first_ord")


INVENTORY_SQL = """
WITH p AS (SELECT lang || ':' || CAST(quality AS VARCHAR) AS field, d.doc_id AS page, n_chars % 100 / 100 AS confidence,
  CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE source END AS table_type, d.doc_id AS ord FROM documents d JOIN labels USING (doc_id))
SELECT field, count(DISTINCT page) AS n_pages, min(page) AS first_page, max(confidence) AS confidence,
  arg_max(nullif(table_type, ''), CASE WHEN table_type <> '' THEN ord END) AS table_type, min(ord) AS first_ord FROM p GROUP BY field
"""


def _records(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return d.join(read_table(spark, sf, "labels"), "doc_id", "left").withColumn(
        "note", F.when(F.contains("text", F.lit("icense")), F.lit("x"))
    )


def gap_detect_fill(spark, sf):
    """Fields that most documents lack, and the pages that a search for a term offers to fill them from."""
    records = _records(spark, sf)
    missing = knowledge.gaps(records, ["quality", "toxic", "note", "lang"], 0.5)
    offered = records.where(F.contains(F.lower("text"), F.lit("that"))).orderBy("doc_id").limit(15).agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("pages"))
    return missing.crossJoin(F.broadcast(offered))


GAP_SQL = """
WITH r AS (SELECT d.doc_id, lang, quality, toxic, CASE WHEN contains(text, 'icense') THEN 'x' END AS note, text FROM documents d LEFT JOIN labels USING (doc_id)),
c AS (SELECT count(*) AS n, count_if(quality IS NULL) AS quality, count_if(toxic IS NULL) AS toxic, count_if(note IS NULL) AS note, count_if(lang IS NULL) AS lang FROM r),
l AS (SELECT unnest(['quality', 'toxic', 'note', 'lang']) AS field, unnest([quality, toxic, note, lang]) AS n_missing, n FROM c),
o AS (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS pages FROM (SELECT doc_id FROM r WHERE contains(lower(text), 'that') ORDER BY doc_id LIMIT 15))
SELECT field, n_missing, n, pages FROM l CROSS JOIN o WHERE n_missing > 0.5 * n
"""


def gap_fill_apply(spark, sf):
    """Records whose missing fields are filled from what a search found: the first license line, the last source."""
    records = _records(spark, sf).select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "NOT_FOUND").alias("quality"), F.col("note"), F.lit(None).cast("string").alias("owner"))
    d = read_table(spark, sf, "documents")
    found = d.where(F.contains("text", F.lit("icense"))).select(F.lit("note").alias("field"), F.regexp_extract("text", "([A-Za-z]*icense[a-z]*)", 1).alias("value"), (-F.col("doc_id")).alias("ord"))
    found = found.unionByName(d.select(F.lit("owner").alias("field"), F.when(F.col("lang") == "de", "NOT_FOUND").otherwise(F.col("source")).alias("value"), F.col("doc_id").alias("ord")))
    return knowledge.fill_gaps(records, ["quality", "note", "owner"], found)


FILL_SQL = """
WITH r AS (SELECT d.doc_id, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'NOT_FOUND' END AS quality, CASE WHEN contains(text, 'icense') THEN 'x' END AS note FROM documents d LEFT JOIN labels USING (doc_id)),
n AS (SELECT arg_min(regexp_extract(text, '([A-Za-z]*icense[a-z]*)', 1), doc_id) AS v FROM documents WHERE contains(text, 'icense')),
o AS (SELECT arg_max(source, doc_id) AS v FROM documents WHERE lang <> 'de' AND source <> '')
SELECT doc_id, quality, coalesce(note, n.v) AS note, o.v AS owner, CASE WHEN note IS NULL AND n.v IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN o.v IS NOT NULL THEN 1 ELSE 0 END AS n_filled
FROM r, n, o
"""


def question_priority(spark, sf):
    missing = _records(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality").isNull()).alias("quality"), F.count_if(F.col("note").isNull()).alias("note"))
    long = missing.select("source", "n", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n_missing")) for f in ("quality", "note")))).alias("x")).select("source", "n", "x.*")
    return knowledge.questions(long, F.col("n"))


QUESTION_SQL = """
WITH r AS (SELECT source, quality, CASE WHEN contains(text, 'icense') THEN 'x' END AS note FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT source, count(*) AS n, count_if(quality IS NULL) AS q, count_if(note IS NULL) AS o FROM r GROUP BY 1),
l AS (SELECT source, n, 'quality' AS field, q AS n_missing FROM c UNION ALL SELECT source, n, 'note', o FROM c)
SELECT *, CASE WHEN n_missing > 0.8 * n THEN 'high' ELSE 'medium' END AS priority FROM l WHERE n_missing > 0.5 * n
"""


def schema_suggestions(spark, sf):
    e = read_table(spark, sf, "events")
    seen = e.select(
        F.concat(F.lit("k"), F.get_json_object("props", "$.k"), F.lit(":"), "event_type").alias("field"),
        F.col("event_id").alias("ord"), F.concat_ws("@", "props", F.col("user_id").cast("string")).alias("value"),
    )
    return knowledge.suggestions(seen, 20)


SUGGEST_SQL = """
WITH s AS (SELECT 'k' || json_extract_string(props, '$.k') || ':' || event_type AS field, event_id AS ord, props || '@' || CAST(user_id AS VARCHAR) AS value FROM events)
SELECT field, count(*) AS n_seen, min(ord) AS first_at, arg_min(value, ord) AS example FROM s GROUP BY field HAVING count(*) >= 20
"""


def field_strategy_chain(spark, sf):
    """Every document as a field, with the first of seven ways to find it."""
    d, l = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    f = lambda df, c="doc_id": df.select(F.col(c).alias("field"))
    return knowledge.strategies(
        f(d), f(d.where("n_chars < 200")), f(l.where("quality = 0")), f(l.where("toxic = 1")), f(d.where("lang = 'de'")),
        f(read_table(spark, sf, "benchmark"), "item_id"), f(d.where(F.contains("text", F.lit("@")))),
    )


STRATEGY_SQL = """
SELECT doc_id AS field,
  CASE WHEN n_chars < 200 THEN 'external' WHEN quality = 0 THEN 'explicitly_absent' WHEN toxic = 1 THEN 'absent' WHEN lang = 'de' THEN 'table'
       WHEN doc_id IN (SELECT item_id FROM benchmark) THEN 'pages' WHEN contains(text, '@') THEN 'cross_reference' ELSE 'search' END AS strategy,
  CAST(CASE WHEN n_chars < 200 THEN 0.95 WHEN quality = 0 THEN 0.95 WHEN toxic = 1 THEN 0.8 WHEN lang = 'de' THEN 0.9
       WHEN doc_id IN (SELECT item_id FROM benchmark) THEN 0.8 WHEN contains(text, '@') THEN 0.85 ELSE 0.5 END AS DOUBLE) AS confidence
FROM documents LEFT JOIN labels USING (doc_id)
"""


def external_refs_union(spark, sf):
    d, p, e = (read_table(spark, sf, x) for x in ("documents", "pages", "events"))
    a = d.select(F.col("lang").alias("field"), F.col("source").alias("document"), F.col("doc_id").alias("page"), F.col("doc_id").alias("ord"))
    b = p.select(F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("field"), F.concat(F.lit("src"), (F.col("page_id") % 40).cast("string")).alias("document"), F.col("page_id").alias("page"), F.col("page_id").alias("ord"))
    c = e.select(F.when(F.col("event_id") % 7 == 0, "Unknown").otherwise(F.col("event_type")).alias("field"), F.concat(F.lit("src"), (F.col("user_id") % 10).cast("string")).alias("document"), F.col("event_id").alias("page"), F.col("event_id").alias("ord"))
    return knowledge.external_references(a, b, c)


EXTERNAL_SQL = """
WITH u AS (
  SELECT lang AS field, source AS document, doc_id AS page, 0 AS source FROM documents
  UNION ALL SELECT regexp_extract(html, 'lang="([a-z]*)"', 1), 'src' || CAST(page_id % 40 AS VARCHAR), page_id, 1 FROM pages
  UNION ALL SELECT CASE WHEN event_id % 7 = 0 THEN 'Unknown' ELSE event_type END, 'src' || CAST(user_id % 10 AS VARCHAR), event_id, 2 FROM events)
SELECT field, document, page, CAST(source AS INTEGER) AS source FROM u WHERE field IS NOT NULL AND lower(field) NOT IN ('null', 'none', 'unknown', '')
QUALIFY row_number() OVER (PARTITION BY field, document ORDER BY source, page) = 1
"""

def nested_sections(spark, sf):
    """Orders of a customer as headings, their priority as level, and the customer's last order as last page."""
    o = read_table(spark, sf, "orders")
    last = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_page"))
    heads = o.join(last, "o_custkey").select(
        F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("level"),
        F.col("o_orderstatus").alias("title"), F.col("o_orderkey").alias("page"), "last_page",
    )
    return structure.nested_sections(heads)


NESTED_SECTIONS_SQL = """
WITH RECURSIVE h AS (SELECT o_custkey AS doc, o_orderkey AS ord, CAST(left(o_orderpriority, 1) AS BIGINT) AS level, o_orderstatus AS title,
  max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders),
p AS (
  SELECT h.doc, h.ord, h.level, h.title, h.last, (SELECT min(x.ord) FROM h x WHERE x.doc = h.doc AND x.ord > h.ord AND x.level <= h.level) AS nxt,
    (SELECT max(x.ord) FROM h x WHERE x.doc = h.doc AND x.ord < h.ord AND x.level < h.level) AS parent
  FROM h
), d AS (
  SELECT doc, ord, 1::BIGINT AS depth FROM p WHERE parent IS NULL
  UNION ALL SELECT p.doc, p.ord, depth + 1 FROM d JOIN p ON p.doc = d.doc AND p.parent = d.ord
)
SELECT p.doc, p.ord, level, title, p.ord AS page, CASE WHEN nxt IS NULL THEN last ELSE greatest(p.ord, nxt - 1) END AS page_end, parent, depth FROM p JOIN d USING (doc, ord)
"""


def json_repair_props(spark, sf):
    """Events' properties as answers cut short inside a fence, made whole again."""
    e = read_table(spark, sf, "events")
    cut = F.substring(F.col("props"), F.lit(1), (F.col("event_id") % 12).cast("int"))
    told = F.concat(F.lit("Here it is:\n```json\n"), cut)
    fixed = e.select("event_id", repaired_json(told).alias("json"))
    return fixed.select("event_id", "json", F.get_json_object("json", "$.k").cast("int").alias("k"))


JSON_REPAIR_SQL = """
WITH c AS (SELECT event_id, regexp_extract(substr(props, 1, CAST(event_id % 12 AS INTEGER)), '[0-9]+') AS digits, event_id % 12 AS n FROM events)
SELECT event_id, CASE WHEN n = 0 THEN NULL WHEN digits = '' THEN '{}' ELSE '{"k": ' || digits || '}' END AS json, TRY_CAST(digits AS INTEGER) AS k FROM c
"""


QUERIES = {
    "nested_sections": (nested_sections, NESTED_SECTIONS_SQL),
    "json_repair_props": (json_repair_props, JSON_REPAIR_SQL),
    "chunk_fixed_adaptive": (chunk_fixed_adaptive, CHUNK_SQL),
    "chunk_overlap": (chunk_overlap, OVERLAP_SQL),
    "first_contiguous_block": (first_contiguous_block, BLOCK_SQL),
    "contiguous_blocks": (contiguous_blocks, BLOCKS_SQL),
    "uncovered_pages": (uncovered_pages, UNCOVERED_SQL),
    "section_ranges_lead": (section_ranges_lead, SECTIONS_SQL),
    "range_join_sections": (range_join_sections, RANGE_SQL),
    "interval_overlap": (interval_overlap, OVERLAPS_SQL),
    "toc_from_html": (toc_from_html, TOC_SQL),
    "token_budget": (token_budget, BUDGET_SQL),
    "smart_chunks": (smart_chunks, SMART_SQL),
    "inventory_aggregate": (inventory_aggregate, INVENTORY_SQL),
    "gap_detect_fill": (gap_detect_fill, GAP_SQL),
    "gap_fill_apply": (gap_fill_apply, FILL_SQL),
    "question_priority": (question_priority, QUESTION_SQL),
    "schema_suggestions": (schema_suggestions, SUGGEST_SQL),
    "field_strategy_chain": (field_strategy_chain, STRATEGY_SQL),
    "external_refs_union": (external_refs_union, EXTERNAL_SQL),
}
