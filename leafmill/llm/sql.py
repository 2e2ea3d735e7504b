"""DuckDB SQL for the numbered queries that SQL can express, over whole tables."""

from __future__ import annotations

from leafmill.llm.conversation_repair import OP11_SQL
from leafmill.llm.secret_scan import KINDS, MAX_OWNERS, MAX_REPOSITORIES, SOUGHT
from leafmill.llm.topk_search import OP1_SQL
from leafmill.llm.url_filter import OP13_SQL

WORD = r"[^\x20\x09-\x0D]+"

OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM documents
), e AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d)),
t AS (SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM t) GROUP BY 1),
s AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
    len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) AS n_doubled
  FROM d LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words
    OR word_chars > 16 * n_words OR 2 * n_upper > n_letters OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines) OR 10 * n_doubled > 3 * n_words) AS kept
FROM s
"""

OP4_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT x, x FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(b, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""



def _spans(kind: str, place: int, pattern: str, group: int, more: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, '{kind}' AS kind, {place} AS place, s AS start, s + length(m[i]) AS stop, v[i] AS value FROM (
    SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS s FROM (
      SELECT *, unnest(generate_series(1, len(m))) AS i FROM (
        SELECT doc_id, source, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v, string_split_regex(text, '{p}') AS g FROM d)))
  WHERE {more}"""


OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
b AS ({" UNION ALL ".join(_spans(k, i, SOUGHT.get(k, p), g, f"length(v[i]) >= {n}") for i, (k, p, g, n) in enumerate(KINDS))}),
r AS ({_spans("random", len(KINDS), "[A-Za-z0-9+/_=-]{32,}", 0, "regexp_matches(v[i], '[a-z]') AND regexp_matches(v[i], '[A-Z]') AND regexp_matches(v[i], '[0-9]')")}),
a AS (SELECT * FROM b UNION ALL SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = r.doc_id AND r.start < b.stop AND b.start < r.stop)),
p AS (SELECT DISTINCT value, doc_id, coalesce('=' || source, '') AS owner FROM a),
o AS (SELECT value, count(DISTINCT owner) <= {MAX_OWNERS} AND count(*) <= {MAX_REPOSITORIES} AS live FROM p GROUP BY 1),
t AS (SELECT doc_id, kind, start, place, live, kind || ':' || start || ':' || stop AS span FROM a JOIN o USING (value) WHERE live OR place < {len(KINDS)}),
x AS (SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
  string_agg(CASE WHEN place < {len(KINDS)} THEN span END, ',' ORDER BY start, place) AS base, string_agg(span, ',' ORDER BY start, place) AS spans, count_if(live) AS n_live FROM t GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN x USING (doc_id)
"""

SQL = {"op1_topk_search": OP1_SQL, "op4_jaccard_join": OP4_SQL, "op7_quality_rules": OP7_SQL, "op8_secret_scan": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op13_url_filter": OP13_SQL}
