"""Sections, page ranges, runs and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import ship_code



def sections_from_toc(toc: DataFrame, key: str, last_page: Column) -> DataFrame:
    """Rows of (key, ord, title, page) with page_end: the page before the next entry, not before the own one."""
    order = Window.partitionBy(key).orderBy("ord")
    end = F.greatest(F.col("page"), F.lead("page").over(order) - 1)
    return toc.withColumn("page_end", F.coalesce(end, last_page))


def runs(pages: DataFrame, key: str) -> DataFrame:
    """(key, run, page_start, page_end, n_pages): maximal runs of neighbouring pages, numbered from 1."""
    order = Window.partitionBy(key).orderBy("page")
    islands = pages.select(key, "page").distinct().withColumn("island", F.col("page") - F.row_number().over(order))
    found = islands.groupBy(key, "island").agg(
        F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count(F.lit(1)).alias("n_pages")
    )
    number = F.row_number().over(Window.partitionBy(key).orderBy("page_start"))
    return found.select(key, number.alias("run"), "page_start", "page_end", "n_pages")


def in_sections(points: DataFrame, sections: DataFrame, page: str, width: int = 64) -> DataFrame:
    """Points joined with the first section (by ord) that covers their page.

    Sections are cut along blocks of ``width`` pages, so the join is an equi-join on the block however long they are.
    """
    block = lambda c: F.floor(c / width).cast("long")
    cut = sections.withColumn("block", F.explode(F.sequence(block(F.col("page_start")), block(F.col("page_end")))))
    found = points.withColumn("block", block(F.col(page))).join(cut, "block")
    found = found.where(F.col(page).between(F.col("page_start"), F.col("page_end")))
    return found.drop("block")


def overlapping(left: DataFrame, right: DataFrame, width: int = 64) -> DataFrame:
    """Pairs of intervals (l_start, l_end) and (r_start, r_end) that share a page, each pair once."""
    block = lambda c: F.floor(c / width).cast("long")
    a = left.withColumn("block", F.explode(F.sequence(block(F.col("l_start")), block(F.col("l_end")))))
    b = right.withColumn("block", F.explode(F.sequence(block(F.col("r_start")), block(F.col("r_end")))))
    met = a.join(b, "block").where("l_start <= r_end and r_start <= l_end")
    return met.where(F.col("block") == block(F.greatest("l_start", "r_start"))).drop("block")


def fixed_chunks(documents: DataFrame, size: Column) -> DataFrame:
    """(doc, n_pages, page_start, page_end) of every chunk of ``size`` pages; the last is clipped."""
    start = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_pages"), size.cast("long")))
    out = documents.where("n_pages > 0").select("doc", "n_pages", size.cast("long").alias("size"), start.alias("page_start"))
    return out.withColumn("page_end", F.least(F.col("page_start") + F.col("size") - 1, F.col("n_pages"))).drop("size")


def overlapped(chunks: DataFrame, by: int = 5) -> DataFrame:
    """Chunks stretched by some pages on both sides, except at the document's ends."""
    order = Window.partitionBy("doc").orderBy("page_start")
    first = F.row_number().over(order) == 1
    last = F.lead("page_start").over(order).isNull()
    start = F.when(first, F.col("page_start")).otherwise(F.greatest(F.lit(1), F.col("page_start") - by))
    end = F.when(last, F.col("page_end")).otherwise(F.least(F.col("n_pages"), F.col("page_end") + by))
    return chunks.select("doc", "n_pages", start.alias("page_start"), end.alias("page_end"))


def uncovered_runs(documents: DataFrame, covered: DataFrame) -> DataFrame:
    """Runs of pages 1 .. n_pages of each document that no row of (doc, page) covers."""
    every = documents.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_pages"))).alias("page"))
    return runs(every.join(covered, ["doc", "page"], "left_anti"), "doc")


def chunk_ends(n_pages: int, bounds: list[int], least: int, most: int) -> Iterator[tuple[int, int]]:
    """Greedy chunks: each ends before the last bound that leaves it between least and most pages, else at most."""
    start = 1
    while start <= n_pages:
        fit = [b for b in bounds if start + least <= b <= start + most]
        end = min(n_pages, max(fit) - 1 if fit else start + most - 1)
        yield start, end
        start = end + 1


def smart_chunks(documents: DataFrame, sections: DataFrame, least: int = 10, most: int = 30) -> DataFrame:
    """(doc, chunk, page_start, page_end) of boundary-aware chunks; one document's sections make one group."""
    ship_code(documents.sparkSession)
    bounds = sections.select("doc", F.explode(F.array(F.col("page_start"), F.col("page_end") + 1)).alias("bound")).distinct()
    both = documents.join(bounds.groupBy("doc").agg(F.array_sort(F.collect_list("bound")).alias("bounds")), "doc", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, n, found in frame[["doc", "n_pages", "bounds"]].itertuples(index=False):
                inner = sorted({1, n + 1, *(int(b) for b in (found if found is not None else ()) if 1 <= b <= n + 1)})
                rows += [(doc, k + 1, a, b) for k, (a, b) in enumerate(chunk_ends(int(n), inner, least, most))]
            yield pd.DataFrame(rows, columns=["doc", "chunk", "page_start", "page_end"])

    kind = documents.schema["doc"].dataType.simpleString()
    return both.select("doc", "n_pages", "bounds").mapInPandas(run, f"doc {kind}, chunk long, page_start long, page_end long")


def first_and_last(n_pages: Column, first: int = 5, last: int = 15) -> Column:
    """The pages of a document's front and back matter."""
    front = F.sequence(F.lit(1).cast("long"), F.least(n_pages, F.lit(first)))
    back = F.sequence(F.greatest(F.lit(1), n_pages - last + 1), n_pages)
    return F.array_sort(F.array_distinct(F.concat(front, back)))




def nested_sections(headings: DataFrame, last_page: str = "last_page") -> DataFrame:
    """Headings (doc, ord, level, title, page, last_page) as nested sections of any depth.

    A section ends on the page before the next heading of its level or above (the next level that isn't greater), but not
    before its own; without one on the document's last page.  ``parent`` is the ``ord`` of the nearest earlier heading
    of a lesser level, null at the top; ``depth`` counts from 1.  A null level is the top.  ``ord`` is distinct in a document.

    Both are nearest smaller values, found with a stack in one pass over the sorted headings: memory follows the depth,
    not the headings.
    """
    ship_code(headings.sparkSession)
    kind = {c: headings.schema[c].dataType.simpleString() for c in ("doc", "ord", "title", "page")}
    slim = headings.select("doc", "ord", F.coalesce(F.col("level").cast("long"), F.lit(1)).alias("level"), "title", "page", F.col(last_page).alias("last"))
    dealt = slim.repartition("doc").sortWithinPartitions(F.asc_nulls_first("doc"), "ord")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, any_ = None, False
        stack: list[tuple] = []  # open sections: level, ord, title, page, parent, depth, last page
        out: list[tuple] = []
        names = ["doc", "ord", "level", "title", "page", "page_end", "parent", "depth"]

        def close(before) -> None:
            level, ord_, title, page, parent, depth, last = stack.pop()
            end = last if before is None else max(page, before - 1) if page is not None else None
            out.append((now, ord_, level, title, page, end, parent, depth))

        def told(schema: pa.Schema) -> pa.RecordBatch:
            kinds = [schema.field(c).type for c in ("doc", "ord")] + [pa.int64(), *(schema.field(c).type for c in ("title", "page", "page", "ord")), pa.int64()]
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        schema = None
        for batch in frames:
            schema = batch.schema
            for doc, ord_, level, title, page, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not any_ or doc != now:
                    while stack:
                        close(None)
                    now, any_ = doc, True
                while stack and stack[-1][0] >= level:
                    close(page)
                parent = stack[-1][1] if stack else None
                stack.append((level, ord_, title, page, parent, len(stack) + 1, last))
            if len(out) >= 1000:
                yield told(schema)
        while stack:
            close(None)
        if out:
            yield told(schema)

    return dealt.mapInArrow(
        run, f"doc {kind['doc']}, ord {kind['ord']}, level long, title {kind['title']}, page {kind['page']}, page_end {kind['page']}, parent {kind['ord']}, depth long"
    )
