"""Queries over text: search, parsing, normalising.  Each name has a query and the SQL that returns its rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import dictionaries as d
from leafmill.functions import text as t
from leafmill.functions.values import extracted
from leafmill.operators import constraints, search
from leafmill.operators.assembly import fragment, provenance
from leafmill.session import read_table

DOCUMENTS = [("license", "License"), ("public", "Public"), ("the", "Body"), ("de", "Body")]
PHRASES = ["under", "with", "that", "los", "des"]
FIELDS = {"terms": ["licensed"], "time": ["was", "when"], "origin": ["from"], "place": ["in the", "en el"]}
TERMS = ["the", "license", "ing of", "que"]
# A word of its own: letters and digits of any script beside it make it a part of another one.  Java's and RE2's boundaries differ
# in what they take for a word, so the bounds are written out; RE2 looks neither back nor ahead and takes whole words.
ISIN = r"(?:^|[^\p{L}\p{N}_])([A-Z]{2}[A-Z0-9]{10})(?![\p{L}\p{N}_])"
ISIN_WORDS = r"list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{2}[A-Z0-9]{10}'))"


def _pages(spark, sf):
    return read_table(spark, sf, "documents").select(F.col("doc_id").alias("page"), "text")


def _like(words, column):
    return " OR ".join(f"contains({column}, '{w}')" for w in words)


def _case(pairs, column):
    return "CASE " + " ".join(f"WHEN contains({column}, '{w}') THEN '{v}'" for w, v in pairs) + " END"


def search_term_topk(spark, sf):
    return search.search_term(_pages(spark, sf), "license", 50)


SEARCH_TERM_SQL = """
WITH hit AS (SELECT doc_id AS page, text FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 50),
c AS (SELECT page, array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
  lambda x: x <> '' AND contains(lower(x), 'license')), 1, 3), '; ') AS w FROM hit)
SELECT page, CASE WHEN length(w) > 200 THEN w[1:200] || '...' ELSE w END AS context FROM c
"""


def search_patterns_dedupe(spark, sf):
    return search.search_patterns(_pages(spark, sf), TERMS, 80)


SEARCH_PATTERNS_SQL = """
WITH p(term_ord, term) AS (VALUES (0, 'the'), (1, 'license'), (2, 'ing of'), (3, 'que')),
h AS (SELECT doc_id AS page, term_ord, term FROM documents JOIN p ON contains(lower(text), term)),
a AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY term_ord ORDER BY page) <= 20),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY page ORDER BY term_ord) = 1)
SELECT page, CAST(term_ord AS INTEGER) AS term_ord, term FROM b ORDER BY term_ord, page LIMIT 80
"""


def sentence_triple_proximity(spark, sf):
    return search.referred_fields(_pages(spark, sf), DOCUMENTS, PHRASES, FIELDS)


SENTENCES_SQL = f"""
WITH s AS (
  SELECT doc_id AS page, list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda x: trim(x)),
    lambda x: length(x) > 10) AS l FROM documents
), e AS (SELECT page, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM s),
n AS (SELECT *, {_case(DOCUMENTS, 'lower(sentence)')} AS document FROM e WHERE {_like(PHRASES, 'lower(sentence)')}),
f AS (
  {" UNION ALL ".join(f"SELECT *, '{k}' AS field FROM n WHERE document IS NOT NULL AND ({_like(w, 'lower(sentence)')})" for k, w in FIELDS.items())}
)
SELECT field, page, CAST(pos AS INTEGER) AS pos, document,
  CASE WHEN length(sentence) > 100 THEN sentence[1:100] || '...' ELSE sentence END AS quote
FROM f QUALIFY row_number() OVER (PARTITION BY field ORDER BY page, pos) = 1
"""


def regex_isin_extract(spark, sf):
    return search.codes(_pages(spark, sf), ISIN)


ISIN_SQL = f"""
WITH m AS (SELECT doc_id AS page, {ISIN_WORDS} AS l FROM documents)
SELECT page, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS code FROM m
"""


def resolver_context_window(spark, sf):
    return search.after_keyword(_pages(spark, sf), "license", 100, r"([0-9]+\.[0-9]+)")


WINDOW_SQL = r"""
WITH p AS (SELECT doc_id AS page, text, CAST(instr(lower(text), 'license') AS INTEGER) AS place FROM documents)
SELECT page, place, nullif(regexp_extract(text[place:place + 99], '([0-9]+\.[0-9]+)', 1), '') AS value
FROM p WHERE place > 0
"""


def line_context_match(spark, sf):
    return search.near_lines(_pages(spark, sf), ["there", "license", "nder"], r"([A-Za-z]+shed)")


LINES_SQL = r"""
WITH s AS (SELECT doc_id AS page, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT page, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM s),
a AS (SELECT *, lower(concat_ws(chr(10), lag(line) OVER w, line, lead(line) OVER w)) AS around,
  regexp_extract(line, '([A-Za-z]+shed)', 1) AS value FROM e WINDOW w AS (PARTITION BY page ORDER BY pos))
SELECT page, CAST(pos AS INTEGER) AS pos, value FROM a
WHERE value <> '' AND (contains(around, 'there') OR contains(around, 'license') OR contains(around, 'nder'))
QUALIFY row_number() OVER (PARTITION BY page ORDER BY pos) = 1
"""


def _clauses(spark, sf):
    """Restrictions written from numbers: every clause of every line item."""
    q = F.col("l_quantity").cast("int").cast("string")
    line = F.col("l_linenumber")
    kind = (
        F.when(line == 1, "single issuer").when(line == 2, "emerging country").when(line == 3, "industry")
        .when(line == 4, "liquid assets").when(line == 5, "bond").otherwise("other")
    )
    sense = F.when(line % 3 == 0, "max ").when(line % 3 == 1, "").otherwise("at least ")
    unit = F.when(line % 2 == 0, " percent ").otherwise("% ")
    text = F.concat(sense, q, unit, kind, F.lit("; ; see notes; no more than "), line.cast("string"), F.lit(".5 % of stock"))
    return read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"))


def constraint_parse(spark, sf):
    return constraints.restrictions(_clauses(spark, sf), "text", ["l_orderkey", "l_linenumber"])


CONSTRAINT_SQL = f"""
WITH c AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_linenumber % 3 = 0 THEN 'max ' WHEN l_linenumber % 3 = 1 THEN '' ELSE 'at least ' END
    || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN ' percent ' ELSE '% ' END
    || CASE l_linenumber WHEN 1 THEN 'single issuer' WHEN 2 THEN 'emerging country' WHEN 3 THEN 'industry'
       WHEN 4 THEN 'liquid assets' WHEN 5 THEN 'bond' ELSE 'other' END
    || '; ; see notes; no more than ' || CAST(l_linenumber AS VARCHAR) || '.5 % of stock' AS text FROM lineitem
), s AS (SELECT l_orderkey, l_linenumber,
  list_filter(list_transform(string_split(text, ';'), lambda x: trim(x)), lambda x: x <> '') AS l FROM c),
e AS (SELECT l_orderkey, l_linenumber, unnest(l) AS text, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM s),
p AS (SELECT *, lower(text) AS low,
  coalesce(TRY_CAST(nullif(regexp_extract(text, '(\\d+(?:\\.\\d+)?)\\s*%', 1), '') AS DOUBLE),
    TRY_CAST(nullif(regexp_extract(lower(text), '(\\d+(?:\\.\\d+)?)\\s*percent', 1), '') AS DOUBLE)) AS value FROM e),
k AS (SELECT *, CASE {" ".join(f"WHEN {_like(w, 'low')} THEN '{n}'" for n, w in d.RESTRICTIONS.items())} ELSE 'asset_limit' END AS type FROM p)
SELECT l_orderkey, l_linenumber, pos, text, type, value,
  CASE WHEN coalesce(value, 0) <> 0 THEN 'percent' END AS unit,
  CASE WHEN {_like(d.MAX_WORDS, 'low')} THEN 'max' WHEN {_like(d.MIN_WORDS, 'low')} THEN 'min'
       WHEN type = 'concentration_limit' THEN 'max' END AS comparator
FROM k
"""


def amount_days_parse(spark, sf):
    o = read_table(spark, sf, "orders")
    whole = F.floor("o_totalprice").cast("long").cast("string")
    thousands = F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1,")
    key = F.col("o_orderkey")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("minimum EUR "), thousands, F.lit(".50 for "), (key % 90).cast("string"), F.lit(" days")))
        .when(key % 4 == 1, F.concat(thousands, F.lit(" CHF held three months")))
        .when(key % 4 == 2, F.concat(F.lit("$"), whole, F.lit(" for One Year, fully hedged")))
        .otherwise(F.concat(F.lit("none, ratio "), (key % 100).cast("string"), F.lit(" %")))
    )
    told = o.select("o_orderkey", text.alias("text"))
    amount, currency = t.amount(F.col("text"))
    return told.select(
        "o_orderkey", amount.alias("amount"), currency.alias("currency"), t.days(F.col("text")).alias("days"),
        t.hedge_ratio(F.col("text")).alias("hedge"),
    )


AMOUNT_SQL = r"""
WITH w AS (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole,
  format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS thousands FROM orders),
c AS (SELECT o_orderkey, CASE o_orderkey % 4
  WHEN 0 THEN 'minimum EUR ' || thousands || '.50 for ' || CAST(o_orderkey % 90 AS VARCHAR) || ' days'
  WHEN 1 THEN thousands || ' CHF held three months'
  WHEN 2 THEN '$' || whole || ' for One Year, fully hedged'
  ELSE 'none, ratio ' || CAST(o_orderkey % 100 AS VARCHAR) || ' %' END AS text FROM w),
m AS (SELECT *, regexp_extract(text, '(EUR|USD|GBP|CHF|\$|€|£)\s*([\d,]+(?:\.\d+)?)', 2) AS a1,
  regexp_extract(text, '(EUR|USD|GBP|CHF|\$|€|£)\s*([\d,]+(?:\.\d+)?)', 1) AS c1,
  regexp_extract(text, '([\d,]+(?:\.\d+)?)\s*(EUR|USD|GBP|CHF)', 1) AS a2,
  regexp_extract(text, '([\d,]+(?:\.\d+)?)\s*(EUR|USD|GBP|CHF)', 2) AS c2 FROM c)
SELECT o_orderkey, TRY_CAST(nullif(replace(CASE WHEN c1 <> '' THEN a1 ELSE a2 END, ',', ''), '') AS DOUBLE) AS amount,
  CASE WHEN c1 = '$' THEN 'USD' WHEN c1 = '€' THEN 'EUR' WHEN c1 = '£' THEN 'GBP' ELSE nullif(CASE WHEN c1 <> '' THEN c1 ELSE c2 END, '') END AS currency,
  coalesce(TRY_CAST(nullif(regexp_extract(lower(text), '(\d+)\s*(?:day|days)', 1), '') AS INTEGER),
    CASE WHEN contains(lower(text), 'three months') THEN 90 WHEN contains(lower(text), 'one year') THEN 365 END) AS days,
  CASE WHEN contains(lower(text), 'fully hedged') THEN 100.0
    ELSE TRY_CAST(nullif(regexp_extract(text, '(\d+(?:\.\d+)?)\s*%', 1), '') AS DOUBLE) END AS hedge
FROM m
"""


def name_normalize(spark, sf):
    """Normal names of all parts, suppliers and customers, with the first shortest name of each."""
    part = read_table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" - "), "p_brand").alias("name"))
    supplier = read_table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    customer = read_table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.concat(F.lit("  "), "c_name", F.lit("-"), "c_mktsegment").alias("name"))
    names = part.unionByName(supplier).unionByName(customer)
    named = names.withColumn("bare", t.strip_prefix(F.col("name"), ["Supplier#", "  Customer#"]))
    named = named.withColumn("normal", t.normal_name(F.col("bare")))
    return named.groupBy("kind", "normal").agg(
        F.count(F.lit(1)).alias("n_names"), F.min_by("name", F.struct(F.length("name"), "id")).alias("canonical")
    )


NAMES_SQL = """
WITH n AS (
  SELECT 'part' AS kind, p_partkey AS id, p_name || ' - ' || p_brand AS name FROM part
  UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'customer', c_custkey, '  ' || c_name || '-' || c_mktsegment FROM customer
), b AS (SELECT *, CASE WHEN starts_with(name, 'Supplier#') THEN name[10:] WHEN starts_with(name, '  Customer#') THEN name[12:] ELSE name END AS bare FROM n),
m AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(trim(lower(bare)), ' - ', ' '), ' – ', ' '), ' — ', ' '), '-', ' '), '\\s+', ' ', 'g')) AS normal FROM b)
SELECT kind, normal, count(*) AS n_names, first(name ORDER BY length(name), id) AS canonical FROM m GROUP BY ALL
"""


def cell_reference_ratio(spark, sf):
    """Cells made of the events' JSON properties: which columns refer elsewhere instead of giving values."""
    e = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    cell = (
        F.when(k % 5 == 0, "see annual report").when(k % 5 == 1, "N/A").when(k % 5 == 2, "KIID")
        .when((k % 5 == 3) & (F.col("event_type") != "click"), "refer to website").otherwise(k.cast("string"))
    )
    cells = e.select((F.col("user_id") % 10).alias("table"), F.col("event_type").alias("column"), F.col("event_id").alias("row"), cell.alias("cell"))
    return search.referring_columns(cells, [("kiid", "KIID"), ("annual report", "Annual Report"), ("website", "Website")])


CELLS_SQL = """
WITH c AS (
  SELECT user_id % 10 AS "table", event_type AS "column", event_id AS row, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), x AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'see annual report' WHEN k % 5 = 1 THEN 'N/A' WHEN k % 5 = 2 THEN 'KIID'
  WHEN k % 5 = 3 AND "column" <> 'click' THEN 'refer to website' ELSE CAST(k AS VARCHAR) END AS cell FROM c),
r AS (SELECT *, CASE WHEN lower(trim(cell)) NOT IN ('', '-', 'n/a', 'na', '—', '–') AND length(cell) <= 80 THEN
  CASE WHEN contains(lower(cell), 'kiid') THEN 'KIID' WHEN contains(lower(cell), 'annual report') THEN 'Annual Report'
       WHEN contains(lower(cell), 'website') THEN 'Website' END END AS document FROM x)
SELECT "table", "column", count(document) AS n_refs, count_if(coalesce(trim(cell), '') <> '') AS n_filled,
  arg_max(document, CASE WHEN document IS NOT NULL THEN row END) AS document
FROM r GROUP BY 1, 2 HAVING count(document) > 0.3 * count_if(coalesce(trim(cell), '') <> '')
"""


def provenance_slice(spark, sf):
    """Pages to patterns to codes to extracted values to counts, end to end, over the pages of a search report."""
    return _provenance(spark, sf, 400)


def provenance_whole(spark, sf):
    """Pages to patterns to codes to extracted values to counts, end to end, over all pages with a term."""
    return _provenance(spark, sf, None)


def _provenance(spark, sf, most):
    docs = read_table(spark, sf, "documents")
    pages = docs.select(F.col("doc_id").alias("page"), "text")
    hits = search.search_patterns(pages, TERMS, most)
    found = search.codes(pages.join(hits.select("page"), "page", "left_semi"), ISIN)
    best = found.groupBy("page").agg(F.min_by("code", "pos").alias("code"))
    value = extracted(F.col("code"), F.col("page"), None, F.when(F.col("code").isNotNull(), 0.9).otherwise(1.0), F.when(F.col("term") == "que", "not_applicable"))
    told = hits.join(best, "page", "left").select("term", value.alias("ev")).select("term", "ev.*")
    return provenance(told, "term")


SLICE_SQL = f"""
WITH p(term_ord, term) AS (VALUES (0, 'the'), (1, 'license'), (2, 'ing of'), (3, 'que')),
h AS (SELECT doc_id AS page, term_ord, term FROM documents JOIN p ON contains(lower(text), term)),
a AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY term_ord ORDER BY page) <= 100),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY page ORDER BY term_ord) = 1),
v AS (SELECT term, {ISIN_WORDS}[1] AS code FROM b JOIN documents ON doc_id = page)
SELECT term, count(*) AS n_total, count(code) AS n_high, CAST(0 AS BIGINT) AS n_low, count_if(code IS NULL) AS n_not_found,
  CAST(0 AS BIGINT) AS n_not_in_document, count_if(code IS NULL AND term = 'que') AS n_not_applicable,
  CAST(0 AS BIGINT) AS n_in_external_doc, CAST(0 AS BIGINT) AS n_inherited,
  count_if(code IS NULL AND term <> 'que') AS n_extraction_failed, count_if(code IS NULL AND term <> 'que') AS n_actionable
FROM v GROUP BY term
"""

WHOLE_SQL = f"""
WITH p(term_ord, term) AS (VALUES (0, 'the'), (1, 'license'), (2, 'ing of'), (3, 'que')),
b AS (SELECT doc_id AS page, text, arg_min(term, term_ord) AS term FROM documents JOIN p ON contains(lower(text), term) GROUP BY 1, 2),
v AS (SELECT term, {ISIN_WORDS}[1] AS code FROM b)
SELECT term, count(*) AS n_total, count(code) AS n_high, CAST(0 AS BIGINT) AS n_low, count_if(code IS NULL) AS n_not_found,
  CAST(0 AS BIGINT) AS n_not_in_document, count_if(code IS NULL AND term = 'que') AS n_not_applicable,
  CAST(0 AS BIGINT) AS n_in_external_doc, CAST(0 AS BIGINT) AS n_inherited,
  count_if(code IS NULL AND term <> 'que') AS n_extraction_failed, count_if(code IS NULL AND term <> 'que') AS n_actionable
FROM v GROUP BY term
"""


def html_report_fragments(spark, sf):
    docs = read_table(spark, sf, "documents")
    sure = (F.col("doc_id") % 10) / 10
    return docs.select("doc_id", fragment(F.col("text"), sure, F.substring("text", 101, 400)).alias("html"))


HTML_SQL = """
WITH d AS (SELECT doc_id, (doc_id % 10) / 10 AS sure, text[101:400] AS quote,
  CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END AS shown FROM documents)
SELECT doc_id, '<span class="' || CASE WHEN sure >= 0.8 THEN 'high' WHEN sure >= 0.5 THEN 'medium' ELSE 'low' END || '" title="'
  || replace(replace(replace(replace(replace(quote, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '">'
  || replace(replace(replace(replace(replace(shown, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</span>' AS html
FROM d
"""

_FIELD_WORDS = [w for words in d.FIELD_WORDS.values() for w in words]
_DOCUMENT_WORDS = [w for w, _ in d.EXTERNAL_DOCUMENTS]


def external_field_scan(spark, sf):
    """Orders as pages of their customer, each with a sentence that speaks of a field, a referral and a document."""
    o = read_table(spark, sf, "orders")
    one = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lit("No word of it here. The "), one(_FIELD_WORDS, k), F.lit(" of the fund: "), one(d.REFERRAL_PHRASES, k + c), F.lit(" our "), one([*_DOCUMENT_WORDS, "own words"], c), F.lit("! "), one(_FIELD_WORDS, c), F.lit(" alone"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pages = o.select(c.alias("doc"), F.row_number().over(order).alias("page"), F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("n_pages"), text.alias("text"))
    return search.external_fields(pages)


EXTERNAL_SQL = f"""
WITH o AS (
  SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page, count(*) OVER (PARTITION BY o_custkey) AS n,
    'No word of it here. The ' || {_FIELD_WORDS}[o_orderkey % {len(_FIELD_WORDS)} + 1] || ' of the fund: ' || {d.REFERRAL_PHRASES}[(o_orderkey + o_custkey) % {len(d.REFERRAL_PHRASES)} + 1]
      || ' our ' || {[*_DOCUMENT_WORDS, "own words"]}[o_custkey % {len(_DOCUMENT_WORDS) + 1} + 1] || '! ' || {_FIELD_WORDS}[o_custkey % {len(_FIELD_WORDS)} + 1] || ' alone' AS text
  FROM orders
), l AS (
  SELECT doc, page, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: length(x) > 10) AS l
  FROM o WHERE page <= 15 OR n > 25 AND page > n - 10
), s AS (SELECT doc, page, CAST(i - 1 AS INTEGER) AS pos, l[i] AS sentence, lower(l[i]) AS low FROM (SELECT doc, page, l, unnest(generate_series(1, len(l))) AS i FROM l)),
f AS (
  SELECT *, {_case(d.EXTERNAL_DOCUMENTS, "low")} AS document,
    unnest(list_filter([{", ".join(f"CASE WHEN {_like(words, 'low')} THEN '{name}' END" for name, words in d.FIELD_WORDS.items())}], lambda x: x IS NOT NULL)) AS field
  FROM s WHERE {_like(d.REFERRAL_PHRASES, "low")}
)
SELECT doc, field, page, pos, document, CASE WHEN length(sentence) > 100 THEN sentence[1:100] || '...' ELSE sentence END AS quote
FROM f WHERE document IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, field ORDER BY page, pos) = 1
"""


QUERIES = {
    "external_field_scan": (external_field_scan, EXTERNAL_SQL),
    "search_term_topk": (search_term_topk, SEARCH_TERM_SQL),
    "search_patterns_dedupe": (search_patterns_dedupe, SEARCH_PATTERNS_SQL),
    "sentence_triple_proximity": (sentence_triple_proximity, SENTENCES_SQL),
    "regex_isin_extract": (regex_isin_extract, ISIN_SQL),
    "resolver_context_window": (resolver_context_window, WINDOW_SQL),
    "line_context_match": (line_context_match, LINES_SQL),
    "constraint_parse": (constraint_parse, CONSTRAINT_SQL),
    "amount_days_parse": (amount_days_parse, AMOUNT_SQL),
    "name_normalize": (name_normalize, NAMES_SQL),
    "cell_reference_ratio": (cell_reference_ratio, CELLS_SQL),
    "provenance_slice": (provenance_slice, SLICE_SQL),
    "provenance_whole": (provenance_whole, WHOLE_SQL),
    "html_report_fragments": (html_report_fragments, HTML_SQL),
}
