"""Search fed by what it learns: many terms at once through an automaton, round by round until nothing new is found."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import search
from leafmill.session import in_job, materialize, ship_code

#: Terms of one automaton; more are looked for in further scans.
MOST_TERMS = 100_000


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds all terms, each known by its place in the list; of equal ones the first counts, empty ones are found nowhere."""
    out = ahocorasick.Automaton()
    for k, x in enumerate(terms):
        if x and x not in out:
            out.add_word(x, k)
    if len(out):
        out.make_automaton()
    return out


def term_hits(pages: DataFrame, terms: list[str], first: bool = False, most: int = MOST_TERMS) -> DataFrame:
    """(page, term): the places in ``terms`` of all terms that a page's text holds in any case, in one scan of the pages.

    With ``first`` a page gives one of its terms only, whichever is met first.  The list may have any length: it is
    broadcast in stretches of ``most`` terms, and each is one scan.  Null texts hold nothing.
    """
    spark = pages.sparkSession
    ship_code(spark)
    slim = pages.select("page", F.lower("text").alias("text"))
    kind = slim.schema["page"].dataType.simpleString()
    out = None
    for at in range(0, max(len(terms), 1), most):
        known = spark.sparkContext.broadcast([x.lower() for x in terms[at : at + most]])

        def run(batches: Iterator[pa.RecordBatch], known=known, at=at) -> Iterator[pa.RecordBatch]:
            find = automaton(known.value)
            for batch in batches:
                rows, hits = [], []
                for k, text in enumerate(batch.column("text").to_pylist() if len(find) else ()):
                    if text:
                        found = (x for _, x in find.iter(text))
                        mine = [x for x in [next(found, None)] if x is not None] if first else sorted(set(found))
                        rows += [k] * len(mine)
                        hits += [at + x for x in mine]
                yield pa.RecordBatch.from_arrays([batch.column("page").take(pa.array(rows, pa.int64())), pa.array(hits, pa.int32())], names=["page", "term"])

        part = slim.mapInArrow(run, f"page {kind}, term int")
        out = part if out is None else out.unionByName(part)
    return out


def learned_search(pages: DataFrame, terms: list[str], pattern: str, letters: int = 3) -> tuple[DataFrame, DataFrame]:
    """(page, round) of all pages found and (term, round) of all terms, when codes on found pages teach new terms.

    Round 0 searches for the given terms.  The first ``letters`` of every code (the pattern's first group) on a page that
    was just found are terms of the next round, unless they are known.  Rounds are semi-naive: each looks for its new
    terms only, on pages not found yet, until a round teaches nothing.  A page is found once; a null page is one.
    """
    spark = pages.sparkSession
    text = materialize(pages.select("page", "text"), "pages")
    given = list(dict.fromkeys(x.lower() for x in terms if x))
    fresh, number = given, 0
    learned = spark.createDataFrame([(x, 0) for x in given], "term string, round int")
    found = None
    while fresh:
        hits = term_hits(text, fresh, first=True).select("page").distinct().withColumn("round", F.lit(number))
        hits = materialize(hits, "found")
        found = hits if found is None else found.unionByName(hits)
        same = text["page"].eqNullSafe(hits["page"])
        told = search.codes(text.join(hits.select("page"), same, "left_semi"), pattern)
        new = told.select(F.lower(F.substring("code", 1, letters)).alias("term")).distinct().join(learned, "term", "left_anti")
        number += 1
        # New terms are what the next scan is for, so they come to the driver; each is a few letters long.
        new = materialize(new.withColumn("round", F.lit(number)), "terms")
        learned = learned.unionByName(new)
        fresh = [r["term"] for r in new.collect()]
        if fresh:
            text = materialize(text.join(hits.select("page"), same, "left_anti"), "pages")
    if found is None:
        found = pages.select("page").limit(0).withColumn("round", F.lit(0))
    return found, learned


def learned_rows(pages: DataFrame, terms: list[str], pattern: str, letters: int = 3) -> DataFrame:
    """What :func:`learned_search` finds and learns, as (kind, name, round)."""

    def work() -> DataFrame:
        found, learned = learned_search(pages, terms, pattern, letters)
        told = found.select(F.lit("page").alias("kind"), F.col("page").cast("string").alias("name"), "round")
        return told.unionByName(learned.select(F.lit("term").alias("kind"), F.col("term").alias("name"), "round"))

    return in_job("learned", work)
