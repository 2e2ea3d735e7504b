"""Later passes over what a first pass has found: learned terms, second looks, broadcast rows, recovery and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import normal_name
from leafmill.session import ship_code


def learned_terms(found: DataFrame, letters: int = 3) -> DataFrame:
    """(term, ord): the first letters of found values in order of first sight; empty and missing ones teach nothing."""
    told = found.where(F.col("value").isNotNull() & ~F.col("value").isin("", "NOT_FOUND"))
    return told.groupBy(F.substring("value", 1, letters).alias("term")).agg(F.min("ord").alias("ord"))


def second_tables(first: DataFrame, second: DataFrame) -> DataFrame:
    """Tables (doc, page_start, page_end, kind) of both passes; of the second only those that start on no known page."""
    covered = first.select("doc", F.explode(F.sequence("page_start", "page_end")).alias("page_start")).distinct()
    fresh = second.join(covered, ["doc", "page_start"], "left_anti").withColumn("again", F.lit(True))
    return first.withColumn("again", F.lit(False)).unionByName(fresh.select(*first.columns, "again"))


def second_names(first: DataFrame, second: DataFrame) -> DataFrame:
    """Names (doc, name, ord) of both passes, the first of each normalised name."""
    both = first.withColumn("again", F.lit(0)).unionByName(second.withColumn("again", F.lit(1)))
    order = Window.partitionBy("doc", normal_name(F.col("name"))).orderBy("again", "ord")
    return both.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def apply_rows(classes: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """Classes (fund, class, fields) with found values of matching rows written over them; the last row in order counts."""
    found = lambda f: F.col(f).isNotNull() & (F.col(f) != "NOT_FOUND")
    last = rows.groupBy("fund", "class").agg(*(F.max_by(f, F.when(found(f), F.col("ord"))).alias(f"new_{f}") for f in fields))
    out = classes.join(last, ["fund", "class"], "left")
    return out.select("fund", "class", *(F.coalesce(f"new_{f}", f).alias(f) for f in fields))


def table_info(findings: DataFrame, words: list[str]) -> DataFrame:
    """(field, pages, columns, has_name, name_column) from findings (field, pages, columns, ord).

    Pages are united, the first filled columns count, and the name column is the first that holds one of the words.
    """
    filled = F.when(F.size("columns") > 0, F.col("ord"))
    hit = lambda c: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(c), w))
    out = findings.groupBy("field").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("pages"), F.min_by("columns", filled).alias("columns"),
        F.bool_or(F.exists("columns", hit)).alias("has_name"),
    )
    return out.withColumn("name_column", F.get(F.filter("columns", hit), F.lit(0)))


def exploration_summary(mentions: DataFrame) -> DataFrame:
    """(doc, n_names, pages): names with a section of their own and all pages where they stand."""
    own = F.col("dedicated")
    return mentions.groupBy("doc").agg(
        F.count_distinct(F.when(own, F.col("name"))).alias("n_names"), F.array_sort(F.collect_set(F.when(own, F.col("page")))).alias("pages")
    )


def recover(failed: DataFrame, resolved: DataFrame) -> DataFrame:
    """(id, field, value, reason, outcome) of failed values after resolvers ran: resolved, upgraded or still failed."""
    told = resolved.select("id", "field", F.col("value").alias("new_value"), F.col("reason").alias("new_reason"))
    out = failed.join(told, ["id", "field"], "left")
    outcome = (
        F.when(F.col("new_value").isNotNull(), "resolved")
        .when(F.coalesce(F.col("new_reason"), F.lit("extraction_failed")) != "extraction_failed", "upgraded").otherwise("failed")
    )
    return out.select(
        "id", "field", F.coalesce("new_value", F.lit("NOT_FOUND")).alias("value"),
        F.when(F.col("new_value").isNull(), F.coalesce("new_reason", F.lit("extraction_failed"))).alias("reason"), outcome.alias("outcome"),
    )


def run_score(critic: Column, high: Column, total: Column, missing: Column) -> Column:
    """A critic's mean where there is one, else the share of sure values among those found."""
    return F.coalesce(critic, F.when(total > missing, high / (total - missing)), F.lit(0.0))


def section_chunks(sections: list[tuple[int, int]], n_pages: int, whole: int = 50, part: int = 30) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) in order: sections gathered while their sizes add up to ``whole`` pages at most, larger ones in
    parts, then each run of pages that none covers; without sections, parts of the whole document."""
    if not sections:
        yield from ((x, min(x + part - 1, n_pages), "naive") for x in range(1, n_pages + 1, part))
        return
    out: list[tuple[int, int, str]] = []
    held: list[int] = []  # first page, last page and sizes of the sections gathered so far

    def close() -> None:
        if held:
            out.append((held[0], held[1], "complete"))
            held.clear()

    for a, b in sections:
        size = b - a + 1
        if size > whole:
            close()
            out += [(x, min(x + part - 1, b), "partial_section") for x in range(a, b + 1, part)]
        elif held and held[2] + size <= whole:
            held[1:] = [b, held[2] + size]
        else:
            close()
            held[:] = [a, b, size]
    close()
    known = {p for a, b, _ in out for p in range(a, b + 1)}
    first = None
    for p in range(1, n_pages + 2):
        if p <= n_pages and p not in known:
            first = first or p
        elif first:
            out.append((first, p - 1, "gap"))
            first = None
    yield from sorted(out)


def structure_aware_chunks(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc, chunk, page_start, page_end, kind) of documents (doc, n_pages) from sections (doc, ord, page_start, page_end)."""
    ship_code(documents.sparkSession)
    held = sections.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "page_start", "page_end"))).alias("s"))
    both = documents.join(held, "doc", "left").select("doc", "n_pages", F.col("s.page_start").alias("a"), F.col("s.page_end").alias("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, n, a, b in frame.itertuples(index=False):
                pairs = [(int(x), int(y)) for x, y in zip(a, b, strict=True)] if a is not None else []
                rows += [(doc, k + 1, *c) for k, c in enumerate(section_chunks(pairs, int(n)))]
            yield pd.DataFrame(rows, columns=["doc", "chunk", "page_start", "page_end", "kind"])

    kind = documents.schema["doc"].dataType.simpleString()
    return both.mapInPandas(run, f"doc {kind}, chunk long, page_start long, page_end long, kind string")
