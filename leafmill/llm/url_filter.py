"""URL filters: rules by host and path, and exact membership in a block list by a cascade of Bloom filters.

A *cascade* is built once for all keys that the corpus holds.  Its first filter encodes the listed keys; the second the
unlisted keys that the first one lets through; the third the listed keys that the second lets through; and so on until
none is.  A key of the corpus then walks down the filters to the first that knows it not: listed if that filter stands
at an even place, unlisted at an odd one; a key that all of them know is listed if their number is odd.  So the answer is
exact for every key of the corpus, and a row is judged without a join.

A filter is an array of 64-bit words; a key has one word and up to eight bits in it.  Filters are read as scalar
subqueries from tables in the shared folder, so each task gets them with its plan.  They hold MOST_WORDS words (16 MB) at
most: more keys are dealt by hash into shards, and each shard's rows are judged under the shard's own cascade.

Rules are (verdict, host, path): a rule fits the host and everything below it where the path starts with the rule's; of
those that fit, the longest host and path wins, the first of equal ones.

Null urls and urls without ``://`` have an empty host and path, which is a key like others.  Null keys of a list are left
out, repeated ones count once, keys that the corpus lacks cost nothing.  An empty list blocks nothing.  Repeated rows
give repeated rows; other columns are kept under their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import in_job, materialize, read_table

#: Words of one filter at most: 16 MB.
MOST_WORDS = 1 << 21
#: No cascade of keys with different hashes is that deep.
MOST_LEVELS = 200

# The rules of the query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# The listed names of the query; every host at or below one of them is listed.
LISTED = tuple(
    f"{name}.example.{top}"
    for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
)


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What stands between the host and the next ``?`` or ``#``; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def below(host_: Column, name: str) -> Column:
    """Whether a host is ``name`` or a subdomain of it."""
    return (host_ == name) | F.endswith(host_, F.lit(f".{name}"))


def by_rule(host_: Column, path_: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (its host and path, else null) and its verdict."""
    name, verdict = F, F
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = below(host_, h) & F.startswith(path_, F.lit(p))
        name, verdict = name.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    return (name.otherwise(F.lit(None)), verdict.otherwise(F.lit(None))) if rules else (F.lit(None).cast("string"),) * 2


def _word(key: Column, level: int, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level)), F.lit(words))


def _bits(key: Column, level: int, n: int) -> Column:
    """A word with the key's bits set; each is read off another stretch of one hash."""
    mixed, one = F.xxhash64(F.lit(level), key), F.lit(1).cast("long")
    places = (F.pmod(F.shiftright(mixed, 7 * k), F.lit(64)).cast("int") for k in range(n))
    return reduce(lambda a, b: a.bitwiseOR(b), (F.call_function("shiftleft", one, x) for x in places))


class Cascade:
    """Filters of one shard, each (table of one row, number of words, number of bits)."""

    def __init__(self) -> None:
        self.levels: list[tuple[DataFrame, int, int]] = []

    def add(self, keys: DataFrame, n_keys: int, bits_a_key: int) -> None:
        """One more filter, which encodes ``keys``."""
        level = len(self.levels)
        words = max(1, -(-n_keys * bits_a_key // 64))
        n = max(1, min(8, round(0.7 * bits_a_key)))
        key = F.col("key")
        used = keys.select(_word(key, level, words).alias("word"), _bits(key, level, n).alias("bits"))
        every = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        filled = every.unionByName(used).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        rows = F.array_sort(F.collect_list(F.struct("word", "bits")))
        packed = filled.agg(F.transform(rows, lambda r: r["bits"]).alias("words"))
        self.levels.append((materialize(packed, "filter"), words, n))

    def knows(self, key: Column, level: int) -> Column:
        table, words, n = self.levels[level]
        bits = _bits(key, level, n)
        return F.element_at(table.select("words").scalar(), (_word(key, level, words) + 1).cast("int")).bitwiseAND(bits) == bits

    def holds(self, key: Column) -> Column:
        """Whether a key of the corpus is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(~self.knows(key, level), F.lit(level % 2 == 1)).otherwise(answer)
        return answer


def build(universe: DataFrame, bits_a_key: int = 8) -> Cascade:
    """The cascade of (key, listed), distinct keys of the corpus."""
    cascade = Cascade()
    for _ in range(MOST_LEVELS):
        n_listed, n_other = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
        side = len(cascade.levels) % 2 == 0
        mine, rest = (n_listed, n_other) if side else (n_other, n_listed)
        if not mine:
            return cascade
        cascade.add(universe.where(F.col("listed") == F.lit(side)), mine, bits_a_key)
        if not rest:
            return cascade
        # This level's own keys stay, to be told apart from the others that it lets through.
        passed = universe.where((F.col("listed") == F.lit(side)) | cascade.knows(F.col("key"), len(cascade.levels) - 1))
        universe = materialize(passed, "universe")
    raise ValueError("keys with equal hashes can't be told apart")


def membership(rows: DataFrame, key: str, listed: DataFrame, into: str = "listed", bits_a_key: int = 8, most_words: int = MOST_WORDS) -> DataFrame:
    """``rows`` with ``into``: whether the row's key is among those of ``listed`` (one column), exact and without a join.

    A null key is never listed.
    """
    own = rows.select(F.col(key).alias("key")).dropna().distinct()
    # The universe: distinct keys of the corpus, each with its mark.  Keys met twice, as own and listed, are both.
    given = listed.select(F.col(listed.columns[0]).alias("key")).dropna()
    marked = own.select("key", F.lit(1).alias("own"), F.lit(0).alias("given")).unionByName(given.select("key", F.lit(0).alias("own"), F.lit(1).alias("given")))
    universe = marked.groupBy("key").agg(F.max("own").alias("own"), F.max("given").alias("given")).where("own = 1")
    universe = materialize(universe.select("key", (F.col("given") == 1).alias("listed")), "universe")
    n_words = universe.count() * bits_a_key // 64
    shards = max(1, -(-n_words // most_words))
    shard = lambda c: F.pmod(F.xxhash64(c, F.lit("shard")), F.lit(shards))
    out = None
    for s in range(shards):
        mine = universe if shards == 1 else universe.where(shard(F.col("key")) == s)
        part = rows if shards == 1 else rows.where(F.coalesce(shard(F.col(key)), F.lit(0)) == s)
        answer = F.coalesce(F.col(key).isNotNull() & build(mine, bits_a_key).holds(F.col(key)), F.lit(False))
        part = part.withColumn(into, answer)
        out = part if out is None else out.unionByName(part)
    return out


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, names: tuple[str, ...] = LISTED, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; where no rule fits, hosts at or below a listed name are blocked.

    The names are matched once for each distinct host; the rows ask the cascade.  Columns of these four names are
    replaced.
    """
    h, p = host(F.col(url)), path(F.col(url))
    rule, told = by_rule(F.col("host"), F.col("path"), rules)
    asked = pages.withColumns({"host": h, "path": p})
    listed = asked.select("host").distinct()
    listed = listed.where(reduce(lambda a, b: a | b, (below(F.col("host"), n) for n in names), F.lit(False)))
    found = membership(asked, "host", listed, into="verdict")
    verdict = F.coalesce(told, F.when(F.col("verdict"), F.lit("block")).otherwise(F.lit("allow")))
    return found.withColumns({"rule": rule, "verdict": verdict})


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return in_job("urls", lambda: judge(pages).select("page_id", "host", "path", "rule", "verdict"))


def _fits(h: str, p: str) -> str:
    return f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"


_ORDERED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
OP13_SQL = rf"""
WITH a AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), b AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM a)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h + p}'" for _, h, p in _ORDERED)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in _ORDERED)}
    WHEN {" OR ".join(f"host = '{n}' OR ends_with(host, '.{n}')" for n in LISTED)} THEN 'block' ELSE 'allow' END AS verdict
FROM b
"""
