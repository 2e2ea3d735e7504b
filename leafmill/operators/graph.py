"""The property graph: entities, relations and facts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed(name: Column, kind: str = "fund") -> Column:
    """Keys read ``type:id``; a bare id gets a type."""
    return F.when(F.contains(name, F.lit(":")), name).otherwise(F.concat(F.lit(f"{kind}:"), name))


def upsert(entities: DataFrame) -> DataFrame:
    """One row a key: pages united, the best confidence, the last name, the first phase."""
    return entities.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("pages"),
        F.max("confidence").alias("confidence"), F.max_by("name", "ord").alias("name"),
        F.min_by("phase", "ord").alias("phase"), F.count(F.lit(1)).alias("n_writes"),
    )


def merge_relations(relations: DataFrame) -> DataFrame:
    """Insert path: one row a (type, subject, object) with the best confidence and the last properties."""
    return relations.groupBy("type", "subject", "object").agg(
        F.max("confidence").alias("confidence"), F.max_by("property", "ord").alias("property"),
        F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n_writes"),
    )


def first_relations(relations: DataFrame) -> DataFrame:
    """Rename path: the first row of each (type, subject, object) stays as it is."""
    order = Window.partitionBy("type", "subject", "object").orderBy("ord")
    return relations.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def rename(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entities under their canonical keys; where several meet, earlier scalars win and lists unite."""
    mapped = entities.join(names.select("key", "canonical"), "key", "left")
    mapped = mapped.withColumn("key", F.coalesce("canonical", "key")).drop("canonical")
    return mapped.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("pages"),
        F.max("confidence").alias("confidence"), F.min_by("name", "ord").alias("name"),
        F.min_by("phase", "ord").alias("phase"), F.count(F.lit(1)).alias("n_writes"),
    )


def rekey_relations(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with both ends under their canonical keys; of those that meet, the first stays as it is."""
    new = names.select("key", "canonical")
    out = relations
    for end in ("subject", "object"):
        out = out.join(new.withColumnsRenamed({"key": end, "canonical": "_new"}), end, "left")
        out = out.withColumn(end, F.coalesce("_new", end)).drop("_new")
    return first_relations(out.select(*relations.columns))


def context_confidence(has_table: Column, has_facts: Column, has_pages: Column) -> Column:
    return F.when(has_table, 0.9).when(has_facts, 0.8).when(has_pages, 0.6).otherwise(0.5)


def contexts(funds: DataFrame, hints: DataFrame, facts: DataFrame) -> DataFrame:
    """Each fund with its first table hint, its facts counted, its pages and the confidence that these give."""
    first = hints.groupBy("key").agg(F.min_by("table_id", "ord").alias("table_id"))
    told = facts.groupBy("key").agg(F.count(F.lit(1)).alias("n_facts"))
    out = funds.join(first, "key", "left").join(told, "key", "left")
    out = out.withColumn("n_facts", F.coalesce("n_facts", F.lit(0).cast("long")))
    sure = context_confidence(F.col("table_id").isNotNull(), F.col("n_facts") > 0, F.col("n_pages") > 0)
    return out.withColumn("confidence", sure)


def relation_type(kind: Column) -> Column:
    """How a fund is tied to a table of this kind."""
    return F.when(kind == "isin", "has_isin_in").otherwise("has_fee_in")


def recorded_tables(notes: DataFrame) -> DataFrame:
    """(doc, ord, key, kind, consolidated, fund) of table notes (doc, ord, kind, pages, consolidated, fund), keyed by kind and first page.

    A table is the same whenever its kind and first page are; each note of it ties funds anew.  Notes without pages are left out.
    """
    key = F.concat(F.lit("table:"), F.col("kind"), F.lit("_"), F.get("pages", F.lit(0)).cast("string"))
    return notes.where(F.size("pages") > 0).select("doc", "ord", key.alias("key"), "kind", "consolidated", F.col("fund"))


def table_links(funds: DataFrame, tables: DataFrame, width: int = 1_000) -> DataFrame:
    """(doc, type, subject, object, ord): the relations that recording tables makes, each with the ``ord`` of its first note.

    A consolidated table is tied to every fund of its document recorded before it, another one to the fund that it names,
    recorded or not; without a name to none.  Funds are (doc, ord, key), tables as :func:`recorded_tables` gives them.

    Both inputs are cut along ``ord`` into blocks of ``width``: a table meets the funds of earlier blocks block by block,
    without comparing, and compares ``ord`` with those of its own block alone.  So a document is no task's own; the rows
    are as many as there are relations.
    """
    block = lambda c: F.floor(F.col(c) / width).alias("block")
    first = funds.groupBy("doc", "key").agg(F.min("ord").alias("fund_ord")).select("doc", F.col("key").alias("subject"), "fund_ord", block("fund_ord"))
    shared = tables.where("consolidated").select("doc", F.col("key").alias("object"), relation_type(F.col("kind")).alias("type"), "ord", block("ord"))
    own = tables.where(~F.col("consolidated") & F.col("fund").isNotNull())
    own = own.select("doc", relation_type(F.col("kind")).alias("type"), keyed(F.col("fund")).alias("subject"), F.col("key").alias("object"), "ord")
    same = first.join(shared, ["doc", "block"]).where("fund_ord < ord")
    of_funds = first.select("doc", F.col("block").alias("fund_block")).distinct()
    cells = of_funds.join(shared.select("doc", "block").distinct(), "doc").where("fund_block < block")
    earlier = cells.join(first.withColumnRenamed("block", "fund_block"), ["doc", "fund_block"]).join(shared, ["doc", "block"])
    columns = ("doc", "type", "subject", "object", "ord")
    every = same.select(*columns).unionByName(earlier.select(*columns)).unionByName(own.select(*columns))
    return every.groupBy("doc", "type", "subject", "object").agg(F.min("ord").alias("ord"))


def orphans(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts whose key is no entity."""
    return facts.join(entities.select("key"), "key", "left_anti")


def bare(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities without a fact."""
    return entities.join(facts.select("key"), "key", "left_anti")
