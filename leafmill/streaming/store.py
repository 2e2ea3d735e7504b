"""A stored table that batches are merged into, rewriting only the buckets that a batch touches.

Rows lie in ``bucket=K`` folders by the hash of their key, and each row carries ``batch``, the number of the last batch that
its bucket took in.  A batch (numbers rise) is merged with the old rows of its own buckets, written aside, and put in
place of these buckets by a dynamic partition overwrite: files of other buckets aren't touched, and as long as tasks
write, readers find the old files.  A bucket that has taken in a batch passes it over when it comes again, so the same batch twice
changes nothing, and a batch that failed half-way is finished by its repetition.

The keys of a batch may be null, which is a key like others.  An empty batch changes nothing.  Tables of any size do, since
a batch reads and writes its own buckets only; ``buckets`` bounds how many numbers come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import in_job, materialize


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def bucket_of(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of the table, with the columns of ``like``; none where it isn't written yet."""
    if not _exists(spark, path):
        return like.limit(0)
    return spark.read.parquet(path).select(*like.columns)


def merge_batch(
    batch: DataFrame, number: int, path: str, keys: tuple[str, ...], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 256,
) -> list[int]:
    """Merge a batch into the table at ``path``; gives the buckets that were rewritten.

    ``merge`` makes the new rows out of the old ones and the batch's, both with the columns of the batch.
    """
    spark = batch.sparkSession

    def work() -> DataFrame:
        fresh = materialize(batch.withColumn("bucket", bucket_of(keys, buckets)), "batch")
        touched = fresh.select("bucket").distinct()
        old = None
        if _exists(spark, path):
            of_batch = [r["bucket"] for r in touched.collect()]  # at most so many as there are buckets
            old = spark.read.parquet(path).where(F.col("bucket").isin(of_batch))
            done = old.groupBy("bucket").agg(F.max("batch").alias("batch")).where(F.col("batch") >= number).select("bucket")
            done = materialize(done, "done")
            old, fresh = (t.join(F.broadcast(done), "bucket", "left_anti") for t in (old, fresh))
        columns = batch.columns
        before = fresh.select(*columns).limit(0) if old is None else old.select(*columns)
        merged = merge(before, fresh.select(*columns)).select(*columns)
        return merged.withColumns({"batch": F.lit(number), "bucket": bucket_of(keys, buckets)}).repartition("bucket")

    # What is overwritten is read, so the new rows are whole before any old file goes.
    made = in_job("merged", work)
    rewritten = sorted(r["bucket"] for r in made.select("bucket").distinct().collect())
    if rewritten:
        made.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return rewritten


def entity_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities (key, pages, confidence, name, ord, n_writes): pages united, the best confidence, the last name, writes added."""
    return old.unionByName(new).groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("pages"), F.max("confidence").alias("confidence"),
        F.max_by("name", "ord").alias("name"), F.max("ord").alias("ord"), F.sum("n_writes").alias("n_writes"),
    )


def first_rows(keys: tuple[str, ...], order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows stay as they were first seen: what is known already, else the first of the batch (discovered fields)."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("_new", F.lit(1)).unionByName(new.withColumn("_new", F.lit(2)))
        rest = F.struct(*(c for c in new.columns if c not in keys))
        return both.groupBy(*keys).agg(F.min_by(rest, F.struct("_new", order)).alias("_x")).select(*keys, "_x.*").select(*new.columns)

    return merge


def sink(path: str, keys: tuple[str, ...], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the table at ``path`` follows a stream, each micro-batch counted once."""

    def take(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, path, keys, merge, buckets)

    return take

