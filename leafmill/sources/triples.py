"""Relations kept in three orders, so that any pattern of (subject, type, object) reads a part of one of them.

``by_subject`` and ``by_object`` are bucketed and sorted by that end; ``by_type`` is partitioned by the type and bucketed
by the subject inside it, so that a type that most relations have still lies in many files.  A pattern with a subject
reads one bucket of the first, else one with an object one bucket of the second, else one with a type its partition, else
the first table is read whole.  Joins by subject or by object find the store's side dealt out and sorted already.

Relations are (subject, type, object) and any further columns; repeated ones stay repeated.  A null in a relation is found by
patterns that leave that place open.  The tables lie in the folder for shared tables and go when the application ends, or
with :meth:`Triples.drop`.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import forget_table, keep_table, scratch_dir

ENDS = ("subject", "type", "object")


class Triples(NamedTuple):
    """The names of the three tables."""

    spark: SparkSession
    by_subject: str
    by_object: str
    by_type: str
    paths: tuple[str, ...]

    def query(self, subject=None, type_=None, object_=None) -> DataFrame:
        """The relations that have the given ends."""
        table = self.by_subject if subject is not None else self.by_object if object_ is not None else self.by_type if type_ is not None else self.by_subject
        out = self.spark.table(table)
        for end, value in zip(ENDS, (subject, type_, object_), strict=True):
            if value is not None:
                out = out.where(F.col(end) == F.lit(value))
        return out.select(*self.spark.table(self.by_subject).columns)

    def drop(self) -> None:
        for path in self.paths:
            forget_table(path)


def write(relations: DataFrame, buckets: int, of_type: int | None = None) -> Triples:
    """Write the relations in three orders; ``of_type`` are the buckets of each type (as many as ``buckets`` if None)."""
    spark = relations.sparkSession
    mark = uuid.uuid4().hex
    names, paths = {}, []
    for order, first in (("subject", "subject"), ("object", "object"), ("type", "subject")):
        name = f"triples_by_{order}_{mark}"
        rest = [c for c in (first, *ENDS) if c != first and (order != "type" or c != "type")]
        n = buckets if order != "type" else of_type or buckets
        keys = (first,) if order != "type" else ("type", first)
        # Dealt as the buckets are, so that each is written by one task as one file.
        writer = relations.repartition(n, *keys[-1:]).write.bucketBy(n, first).sortBy(first, *rest)
        if order == "type":
            writer = writer.partitionBy("type")
        path = f"{scratch_dir(spark).rstrip('/')}/leafmill-{name}"
        writer.option("path", path).format("parquet").saveAsTable(name)
        keep_table(spark, name, path)
        paths.append(path)
        names[f"by_{order}"] = name
    return Triples(spark, **names, paths=tuple(paths))
