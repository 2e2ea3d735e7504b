"""Search over page text: terms, categories, sentences, lines and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import dictionaries as d
from leafmill.functions import text as t


def search_term(pages: DataFrame, term: str, most: int) -> DataFrame:
    """(page, context) of the first ``most`` pages that hold the term in any case."""
    hit = F.contains(F.lower("text"), F.lit(term.lower()))
    found = pages.where(hit).orderBy("page").limit(most)
    return found.select("page", t.snippet(F.col("text"), F.lit(term)).alias("context"))


def category_pages(pages: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """(category, term_ord, term, n_pages, first_page) of every term that some page holds, in one scan of all pages."""
    low = F.lower("text")
    terms = [(c, i, x) for c, words in categories.items() for i, x in enumerate(words)]
    hits = F.array_compact(F.array(*(
        F.when(F.contains(low, F.lit(x.lower())), F.struct(F.lit(c).alias("category"), F.lit(i).alias("term_ord"), F.lit(x).alias("term")))
        for c, i, x in terms
    )))
    found = pages.select("page", F.explode(hits).alias("t"))
    return found.groupBy("t.category", "t.term_ord", "t.term").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page").alias("first_page"))


def search_patterns(pages: DataFrame, terms: list[str], most: int | None) -> DataFrame:
    """(page, term_ord, term): each term gives its first pages, a page keeps its first term, ``most`` rows stay.

    Terms are tested in one scan; a page row fans out only to the terms that it holds.  Without ``most`` every page with a
    term stays.
    """
    low = F.lower("text")
    hits = F.array(*(F.when(F.contains(low, F.lit(x.lower())), F.lit(i)) for i, x in enumerate(terms)))
    names = F.array(*map(F.lit, terms))
    found = pages.select("page", F.explode(F.array_compact(hits)).alias("term_ord"))
    if most is None:
        found = found.groupBy("page").agg(F.min("term_ord").alias("term_ord"))
        return found.select("page", "term_ord", F.get(names, F.col("term_ord")).alias("term"))
    each = max(1, most // len(terms))
    of_term = Window.partitionBy("term_ord").orderBy("page")
    of_page = Window.partitionBy("page").orderBy("term_ord")
    found = found.withColumn("n", F.row_number().over(of_term)).where(F.col("n") <= each)
    found = found.withColumn("n", F.row_number().over(of_page)).where("n = 1")
    found = found.orderBy("term_ord", "page").limit(most)
    return found.select("page", "term_ord", F.get(names, F.col("term_ord")).alias("term"))


def referred_fields(
    pages: DataFrame, documents: list[tuple[str, str]], phrases: list[str], fields: dict[str, list[str]], by: tuple[str, ...] = (),
) -> DataFrame:
    """(field, page, pos, document, quote): the first sentence that names a document, a referral and the field.

    With ``by`` each group of these columns has first sentences of its own, and they are returned too.
    """
    told = pages.select(*by, "page", F.posexplode(t.sentences(F.col("text"))).alias("pos", "sentence"))
    low = F.lower("sentence")
    told = told.withColumn("document", t.first_of(low, documents)).where(F.col("document").isNotNull())
    told = told.where(t.any_of(low, phrases))
    named = F.array(*(F.when(t.any_of(low, words), F.lit(name)) for name, words in fields.items()))
    told = told.withColumn("field", F.explode(F.array_compact(named)))
    first = Window.partitionBy(*by, "field").orderBy("page", "pos")
    told = told.withColumn("n", F.row_number().over(first)).where("n = 1")
    cut = F.when(F.length("sentence") > 100, F.concat(F.left("sentence", F.lit(100)), F.lit("..."))).otherwise(F.col("sentence"))
    return told.select(*by, "field", "page", "pos", "document", cut.alias("quote"))


def referral_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, n_pages) where referrals are looked for: the first 15, and of more than 25 the last 10."""
    return pages.where((F.col("page") <= 15) | (F.col("n_pages") > 25) & (F.col("page") > F.col("n_pages") - 10))


def external_fields(pages: DataFrame) -> DataFrame:
    """(doc, field, page, pos, document, quote): for each document the fields that its pages refer elsewhere for."""
    return referred_fields(referral_pages(pages), d.EXTERNAL_DOCUMENTS, d.REFERRAL_PHRASES, d.FIELD_WORDS, ("doc",))


def codes(pages: DataFrame, pattern: str) -> DataFrame:
    """(page, pos, code) of every match of the pattern's first group."""
    found = F.regexp_extract_all("text", F.lit(pattern), 1)
    return pages.where(F.col("text").rlike(pattern)).select("page", F.posexplode(found).alias("pos", "code"))


def after_keyword(pages: DataFrame, keyword: str, width: int, pattern: str) -> DataFrame:
    """(page, place, value): the pattern's first group within ``width`` characters from a keyword's first place."""
    place = F.locate(keyword.lower(), F.lower("text"))
    near = F.substring(F.col("text"), place, F.lit(width))
    found = pages.select("page", place.alias("place"), F.nullif(F.regexp_extract(near, pattern, 1), F.lit("")).alias("value"))
    return found.where("place > 0")


def matches_near(
    pages: DataFrame, words: list[str], patterns: list[str], before: int, after: int, most: int, quote: int
) -> DataFrame:
    """(page, keyword, value, quote) of pages where a word has matches around its first place.

    Words are tried in order and the first with a match counts.  The value is its first ``most`` matches, pattern by
    pattern, joined by ``, ``; the quote is the trimmed stretch of ``before`` and ``after`` characters, cut.
    """
    low = F.lower("text")
    told = []
    for word in words:
        place = F.locate(word, low)
        start = F.greatest(place - 1 - before, F.lit(0))
        near = F.substring(F.col("text"), start + 1, place - 1 + after - start)
        found = F.concat(*(F.regexp_extract_all(near, F.lit(f"(?i){p}"), 0) for p in patterns))
        hit = F.struct(F.lit(word).alias("keyword"), F.array_join(F.slice(found, 1, most), ", ").alias("value"), F.left(F.trim(near), F.lit(quote)).alias("quote"))
        told.append(F.when((place > 0) & (F.size(found) > 0), hit))
    return pages.select("page", F.coalesce(*told).alias("x")).where("x is not null").select("page", "x.*")


def dividend_dates(pages: DataFrame) -> DataFrame:
    return matches_near(pages, d.DIVIDEND_WORDS, d.DATES, 100, 300, 4, 150)


def valuation_times(pages: DataFrame) -> DataFrame:
    return matches_near(pages, d.VALUATION_WORDS, [d.TIME], 0, 150, 1, 100)


def near_lines(pages: DataFrame, words: list[str], pattern: str) -> DataFrame:
    """(page, pos, value): first line with a match whose own or neighbouring line holds one of the words."""
    lines = pages.select("page", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = Window.partitionBy("page").orderBy("pos")
    around = F.concat_ws("\n", F.lag("line").over(order), F.col("line"), F.lead("line").over(order))
    found = lines.withColumn("around", F.lower(around)).withColumn("value", F.regexp_extract("line", pattern, 1))
    found = found.where((F.col("value") != "") & t.any_of(F.col("around"), words))
    first = found.withColumn("n", F.row_number().over(order)).where("n = 1")
    return first.select("page", "pos", "value")


def referring_columns(cells: DataFrame, documents: list[tuple[str, str]], share: float = 0.3) -> DataFrame:
    """(table, column, n_refs, n_filled, document) where more than ``share`` of the filled cells refer elsewhere.

    Cells are (table, column, row, cell); the document is that of the last referring row.
    """
    told = cells.withColumn("document", t.refers_to(F.col("cell"), documents))
    filled = F.coalesce(F.trim("cell"), F.lit("")) != ""
    out = told.groupBy("table", "column").agg(
        F.count_if(F.col("document").isNotNull()).alias("n_refs"), F.count_if(filled).alias("n_filled"),
        F.max_by("document", F.when(F.col("document").isNotNull(), F.col("row"))).alias("document"),
    )
    return out.where(F.col("n_refs") > share * F.col("n_filled"))
