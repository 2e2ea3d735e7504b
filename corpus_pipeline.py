"""Corpus preparation in stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

1. quality rules: documents that a rule rejects go.
2. n-gram Jaccard join: one document of each group of near-duplicates (five words, 0.8) stays.
3. secret scans: live-looking secrets are replaced by a mark.
4. mixing sources: each document is taken as often as the mix says.
5. BPE: ids and number of tokens of every document taken.

Null, empty and wordless texts go with the first stage, whatever their other columns hold.  Null ids and sources, repeated
ids and rows, and texts of any length pass like others: of equal texts one row stays, rows of one id with different texts
stay apart, a null source is a source of its own.  Every stage but the last returns the columns of its input, whatever
they are named; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, jaccard_join, mixing, quality_rules, secret_scan
from leafmill.session import materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.remix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.vocabulary_path())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: The grouped joins, Newton steps and merges of the stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
