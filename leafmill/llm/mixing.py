"""Mix sources to target weights by entropy balancing.

Every document gets a rate: how often the mix should take it.  Among all rates between 0 and ``limit`` that give each
source its target of words, entropy balancing takes those nearest to 1 in relative entropy.  The convex dual has one
multiplier a source, and the rates are exponentially tilted: ``min(limit, exp(multiplier * size / mean size))``.
Safeguarded Newton steps solve the dual.  A rate depends on source and size alone, so each step sums over the table
of (source, size, documents), which Spark counts once and which is far smaller than the corpus.

Rates become copies inside buckets of a source (some 256 documents each, by hashed id): from the largest document
down, each takes the whole number (0 to ``limit``) that brings the bucket's words nearest to what its rates ask for so
far.  What remains is at most about half the smallest document of each bucket.

Size is the number of ``[^\\x20\\x09-\\x0D]+`` in the text.  Null and empty texts have size 0, rate 1 and take no words.
A null source is a source of its own, last in order.  Rows with the same id, source and size are rounded together, so
their copies differ by one at most; null ids are ids like others.  An empty table gives an empty mix.  The driver
holds no row of a source; the only window without partitions has one row a source.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import in_job, materialize, read_table

WORD = r"[^\x20\x09-\x0D]+"
LIMIT = 3
BUCKET_DOCS = 256
#: A table with one row a source is broadcast up to so many sources (some 100 bytes each), else joined by shuffle.
BROADCAST_SOURCES = 50_000
ROUNDS, PRECISION = 40, 1e-9


def _key(source: Column) -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sources: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``target`` for rows of (key, source, source_size): weights 1, 2, 3, 1, ... in order of source, filled like water.

    All targets together are all sizes together; none is above ``limit`` times its source's size.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.select("*", ((F.row_number().over(in_order) - 1) % 3 + 1).cast("double").alias("weight"))
    weighed = weighed.withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    room = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighed.withColumn("level", room / weights)
    ratio = F.col("cap") / F.col("weight")
    holds = F.when(F.col("level") <= ratio, F.struct(ratio.alias("ratio"), "key", "level"))
    level = F.min(holds).over(everything)["level"]  # of the first source that the level doesn't fill
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return levels.select("key", "source_size", target.alias("target"))


def _small(df: DataFrame, sources: int) -> DataFrame:
    return F.broadcast(df) if sources <= BROADCAST_SOURCES else df


def _tilt(multiplier: str, size: str, mean: str, limit: float) -> Column:
    return F.when(F.col(size) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(float(limit)), F.exp(F.col(multiplier) * F.col(size) / F.col(mean)))
    )


def balance(counted: DataFrame, wanted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(key, multiplier, mean, full) from (key, size, n) and (key, source_size, target); full: all rates are the limit."""
    sizes = counted.where("size > 0").groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = wanted.join(sizes, "key").select(
        "key", "mean", "target", (F.col("target") >= limit * F.col("source_size") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("multiplier"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
    )
    state = materialize(state, "dual")
    n_sources = state.count()
    for _ in range(ROUNDS):
        rate = _tilt("multiplier", "size", "mean", limit)
        x = F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < limit, words * x).otherwise(0.0)
        sums = (
            counted.where("size > 0")
            .join(_small(state.where("not full").select("key", "multiplier", "mean"), n_sources), "key")
            .groupBy("key").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        )
        gap = F.log(F.col("target") / F.col("words"))  # Newton on the logarithm of the words
        low = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap <= 0, F.col("multiplier")).otherwise(F.col("high"))
        stride = 1 + F.abs("multiplier")
        newton = F.when(F.col("slope") > 0, gap * F.col("words") / F.col("slope")).otherwise(F.signum(gap) * stride)
        stepped = state.join(sums, "key").select(
            "key", "mean", "target", "full", gap.alias("gap"), low.alias("low"), high.alias("high"),
            F.when(F.abs(gap) < PRECISION, F.col("multiplier"))
            .otherwise(F.col("multiplier") + F.greatest(-stride, F.least(stride, newton))).alias("multiplier"),
        )
        outside = (F.col("multiplier") <= F.col("low")) | (F.col("multiplier") >= F.col("high"))
        inside = (F.col("low") + F.col("high")) / 2
        stepped = stepped.withColumn(
            "multiplier", F.when((F.abs("gap") >= PRECISION) & outside, F.coalesce(inside, "multiplier")).otherwise(F.col("multiplier"))
        )
        fresh = materialize(stepped, "dual")
        done = state.where("full").unionByName(fresh.drop("gap"))
        worst = fresh.agg(F.max(F.abs("gap"))).first()[0]
        state = done
        if worst is None or worst < PRECISION:
            break
    return state


def mix(docs: DataFrame, text: str = "text", id_: str = "doc_id", source: str = "source", limit: int = LIMIT) -> DataFrame:
    """(id, key, size, source_size, target, rows, copies): ``copies`` of the ``rows`` equal rows together."""
    return in_job("mix", lambda: _mix(docs, text, id_, source, limit))


def _mix(docs: DataFrame, text: str, id_: str, source: str, limit: int) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col(id_).alias("id"), F.col(source).alias("source"), _key(F.col(source)).alias("key"), words.alias("size"))
    slim = slim.groupBy("id", "source", "key", "size").agg(F.count(F.lit(1)).alias("rows"))
    slim = materialize(slim, "sizes")
    counted = materialize(slim.groupBy("key", "size").agg(F.sum("rows").alias("n")), "counted")
    sources = slim.groupBy("key", "source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("source_rows")
    )
    sources = materialize(sources, "sources")
    wanted = materialize(targets(sources, limit), "targets")
    dual = balance(counted, wanted, limit)
    solved = wanted.join(dual.select("key", "multiplier", "mean", "full"), "key", "left").join(
        sources.select("key", "source_rows"), "key"
    )
    rated = slim.drop("source").join(_small(solved, wanted.count()), "key")
    rate = F.when(F.col("full"), F.lit(float(limit))).otherwise(_tilt("multiplier", "size", "mean", limit))
    bucket = F.pmod(F.xxhash64("id", "size"), F.ceil(F.col("source_rows") / BUCKET_DOCS))
    one = F.struct("size", "id", "rows", F.coalesce(rate, F.lit(1.0)).alias("rate"))
    dealt = rated.select("key", "source_size", "target", bucket.alias("bucket"), one.alias("doc"))
    dealt = dealt.groupBy("key", "source_size", "target", "bucket").agg(
        F.sort_array(F.collect_list("doc"), asc=False).alias("docs")
    )

    def copies(owed: Column, x: Column) -> Column:
        """Copies of all rows of x, given the words owed so far."""
        nearest = F.when(x["size"] > 0, F.round((owed + x["rate"] * x["rows"] * x["size"]) / x["size"])).otherwise(x["rows"])
        return F.greatest(F.lit(0).cast("long"), F.least(limit * x["rows"], nearest.cast("long")))

    start = F.struct(F.lit(0.0).alias("owed"), F.expr("cast(array() as array<bigint>)").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        taken = copies(acc["owed"], x)
        owed = acc["owed"] + x["rate"] * x["rows"] * x["size"] - taken * x["size"]
        return F.struct(owed.alias("owed"), F.concat(acc["taken"], F.array(taken)).alias("taken"))

    taken = F.aggregate("docs", start, step, lambda acc: acc["taken"])
    out = dealt.select("key", "source_size", "target", F.explode(F.arrays_zip("docs", taken.alias("copies"))).alias("x"))
    return out.select(
        F.col("x.docs.id").alias("id"), "key", F.col("x.docs.size").alias("size"), "source_size", "target",
        F.col("x.docs.rows").alias("rows"), F.col("x.copies").alias("copies"),
    )


def copies_of(k: Column) -> Column:
    """Copies of the k-th (from 1) of ``rows`` equal rows."""
    return F.floor(F.col("copies") / F.col("rows")) + F.when(k <= F.col("copies") % F.col("rows"), 1).otherwise(0)


def remix(docs: DataFrame, text: str = "text", id_: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    columns = docs.columns
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    taken = mix(docs, text, id_, source).select(F.col("id").alias("_i"), F.col("key").alias("_k"), F.col("size").alias("_s"), "rows", "copies")
    whole = docs.select(F.struct(*(F.col(c) for c in columns)).alias("row"), F.col(id_).alias("id"), _key(F.col(source)).alias("key"), words.alias("size"))
    # One row a document: it grows with the corpus, so it is never to be broadcast.
    joined = whole.join(
        taken.hint("merge"), F.col("id").eqNullSafe(F.col("_i")) & (F.col("key") == F.col("_k")) & (F.col("size") == F.col("_s"))
    )
    equal = Window.partitionBy("id", "key", "size").orderBy(F.lit(0))
    place = F.when(F.col("rows") > 1, F.row_number().over(equal)).otherwise(1)
    many = joined.withColumn("times", copies_of(place).cast("int")).where("times > 0")
    return many.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_n")).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    each = mixed.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (copies_of(F.col("k")) * F.col("size")).alias("taken")
    )
