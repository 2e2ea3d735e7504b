"""Secret scans with corpus-wide ownership frequency.

Candidates of three fixed kinds (``assign``, ``access``, ``hex``) and of one open kind (``random``: long tokens that mix
lower case, upper case and digits) are found in every whole text.  The hash of each candidate's value is then counted
over the corpus by distinct repositories and owners: a value that more than ``max_owners`` owners hold, or that stands in
more than ``max_repositories`` repositories of whatever owners, is a widely copied example; one that stays with few looks
live.  Candidates of the fixed kinds are always reported, with
that verdict; random ones only while they look live, outside the fixed ones.

Owner is the source and repository is the document id unless other columns are named.  Spans count code points from 0,
the end is exclusive, and cover the whole match.  Null and empty texts have none.  Null owners count as one owner, null
ids as one repository.  Repeated rows give repeated rows with the same spans.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import materialize, read_table

# The kinds, their patterns, the group that holds the value, and its least length.
KINDS = (
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Runs of hex digits shorter than the least length never count, so they needn't be matched.
SOUGHT = {"hex": r"[0-9a-f]{24,}"}
RANDOM = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{32,}"
MAX_OWNERS, MAX_REPOSITORIES = 2, 100
#: Values broadcast at most, of some 100 bytes each.
MOST_SPREAD = 50_000
#: Matches whose lengths are added up in one array; it keeps the work of a text linear in its matches.
RUN = 256


def _before(sizes: Column) -> Column:
    """Sums of the items before each item; the work grows with the square of their number."""
    start = F.struct(F.lit(0).alias("sum"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda acc, x: acc + x)


def _let(x: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is worked out once, however often ``make`` reads it."""
    return F.element_at(F.transform(F.array(x), make), 1)


def _running(sizes: Column) -> Column:
    """Sums of the items before each item, by runs of RUN of them, so that work is linear in the items."""
    none = F.expr("cast(array() as array<array<int>>)")
    starts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(RUN))
    cut = F.when(F.size(sizes) > 0, F.transform(starts, lambda at: F.slice(sizes, at, F.lit(RUN)))).otherwise(none)

    def summed(runs: Column) -> Column:
        offsets = _before(F.transform(runs, _total))
        return F.zip_with(runs, offsets, lambda run, offset: F.transform(_before(run), lambda x: x + offset))

    return F.flatten(_let(cut, summed))


def matches(text: Column, pattern: str, group: int) -> Column:
    """(start, end, value) of all leftmost non-overlapping matches.

    ``value`` is the group read off the match alone, so the pattern must not look around itself for it.
    """
    value = lambda m: F.regexp_extract(m, pattern, group) if group else m

    def spans(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        lengths = F.transform(found, F.length)
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), lengths, lambda g, m: g + m)
        ends = _let(steps, lambda x: F.zip_with(_running(x), x, lambda a, b: a + b))
        return F.zip_with(
            ends, found,
            lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), value(m).alias("value")),
        )

    return _let(F.regexp_extract_all(text, F.lit(pattern), 0), spans)


def _kind(text: Column, place: int) -> Column:
    name, pattern, group, least = KINDS[place]
    pattern = SOUGHT.get(name, pattern)
    found = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
    none = F.expr("cast(array() as array<struct<start: int, end: int, place: int, kind: string, value: string>>)")
    told = F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(place).alias("place"), F.lit(name).alias("kind"),
            m["value"].alias("value"),
        ),
    )
    return F.when(text.rlike(pattern), told).otherwise(none)


def _random(text: Column) -> Column:
    none = F.expr("cast(array() as array<struct<start: int, end: int, place: int, kind: string, value: string>>)")
    found = F.filter(
        matches(text, RANDOM, 0),
        lambda m: m["value"].rlike("[a-z]") & m["value"].rlike("[A-Z]") & m["value"].rlike("[0-9]"),
    )
    told = F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(len(KINDS)).alias("place"), F.lit("random").alias("kind"),
            m["value"].alias("value"),
        ),
    )
    return F.when(text.rlike(RANDOM), told).otherwise(none)


def _written(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _apart(spans: DataFrame) -> DataFrame:
    """The spans of each row without the random ones that overlap one of a fixed kind."""
    fixed = F.col("span.place") < len(KINDS)
    forth = Window.partitionBy("row").orderBy("span.start", "span.place").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("span.start"), F.desc("span.place")).rowsBetween(Window.unboundedPreceding, -1)
    told = spans.withColumn("open", F.max(F.when(fixed, F.col("span.end"))).over(forth))
    told = told.withColumn("next", F.min(F.when(fixed, F.col("span.start"))).over(back))
    free = (F.coalesce("open", F.lit(0)) <= F.col("span.start")) & (F.coalesce(F.col("next") >= F.col("span.end"), F.lit(True)))
    return told.where(fixed | free).drop("open", "next")


def _row(*columns: Column) -> Column:
    """128 bits that tell a row's text and places apart from others."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("second"), *columns).alias("b"))


def _judged(each: DataFrame, spread: DataFrame) -> DataFrame:
    """Rows (value, ...) with owners and repositories of their values.

    At most MOST_SPREAD values stand in more than that part of all repositories' entries: these are broadcast.  None of
    the rest is a hot key of the join.
    """
    spread = materialize(spread, "spread")
    bound = (spread.agg(F.sum("repositories")).first()[0] or 0) // MOST_SPREAD
    wide = spread.where(F.col("repositories") > bound)
    often = each.join(F.broadcast(wide), "value")
    if not bound:
        return often
    rest = each.join(F.broadcast(wide.select("value")), "value", "left_anti")
    return often.unionByName(rest.join(spread.where(F.col("repositories") <= bound), "value"))


def scan(
    docs: DataFrame, text: str = "text", id_: str = "doc_id", owner: str = "source", repository: str = "doc_id",
    max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per input row: id, ``base`` and ``spans`` (arrays of start, end, place, kind, value, live), sorted.

    ``base`` holds the fixed kinds, ``spans`` the random ones too.  ``row`` tells rows of other texts apart.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(*(_kind(whole, k) for k in range(len(KINDS)))))
    found = docs.select(
        F.col(id_).alias("id"), F.col(owner).alias("owner"), F.col(repository).alias("repository"),
        _row(F.col(id_), F.col(owner), F.col(repository), whole).alias("row"), base.alias("base"), _random(whole).alias("random"),
    )
    found = materialize(found, "candidates")
    names = ("row", "owner", "repository")
    plain = found.where("size(base) > 0 and size(random) = 0").select(*names, F.explode("base").alias("span"))
    both = found.where("size(random) > 0").select(*names, F.explode(F.concat("base", "random")).alias("span"))
    each = plain.unionByName(_apart(both))
    each = each.withColumn("value", F.sha2(F.col("span.value"), 256))
    spread = (
        each.select("value", "owner", "repository").distinct()
        .groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    )
    told = _judged(each.select("row", "value", "span").distinct(), spread)
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    told = told.withColumn("live", live).where(live | (F.col("span.place") < len(KINDS)))
    told = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("span.*", "live"))).alias("spans"))
    out = found.select("row", "id").join(told, "row", "left")
    none = F.expr(
        "cast(array() as array<struct<start: int, end: int, place: int, kind: string, value: string, live: boolean>>)"
    )
    spans = F.coalesce("spans", none)
    return out.select(
        "row", F.col("id").alias(id_), spans.alias("spans"), F.filter(spans, lambda s: s["place"] < len(KINDS)).alias("base")
    )


def redact(docs: DataFrame, mark: str = "[secret]", text: str = "text", id_: str = "doc_id", owner: str = "source") -> DataFrame:
    """``docs`` with every live span replaced by ``mark``; texts without one stay as they are."""
    columns = docs.columns
    found = scan(docs, text, id_, owner, id_).withColumn("live", F.filter("spans", lambda s: s["live"]))
    found = found.where("size(live) > 0").select("row", "live").dropDuplicates(["row"])
    whole = F.coalesce(F.col(text), F.lit(""))
    packed = docs.select(F.struct(*(F.col(c) for c in columns)).alias("doc"), _row(F.col(id_), F.col(owner), F.col(id_), whole).alias("row"))
    joined = packed.join(found, "row", "left")
    body = F.col(f"doc.{text}")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        grown = F.when(s["end"] > acc["at"], F.concat(acc["out"], kept, F.when(s["start"] >= acc["at"], mark).otherwise("")))
        return F.struct(F.coalesce(grown, acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    clean = F.aggregate(
        "live", start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body)))
    )
    fresh = F.when(F.col("live").isNotNull(), clean).otherwise(body)
    return joined.select(*(fresh.alias(c) if c == text else F.col(f"doc.{c}").alias(c) for c in columns))


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(n(k[0]) for k in KINDS), F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )
