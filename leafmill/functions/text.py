"""Column functions over text: search, parsing and normalising.  Nulls give null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import dictionaries as d

# Patterns of shares, amounts and days.
PERCENT_SIGN, PERCENT_WORD = r"(\d+(?:\.\d+)?)\s*%", r"(\d+(?:\.\d+)?)\s*percent"
CURRENCY_FIRST, AMOUNT_FIRST = r"(EUR|USD|GBP|CHF|\$|€|£)\s*([\d,]+(?:\.\d+)?)", r"([\d,]+(?:\.\d+)?)\s*(EUR|USD|GBP|CHF)"
DAYS = r"(\d+)\s*(?:day|days)"
#: What every text has that can be read as a whole number: one run of digits, no letters.
DIGITS = r"^[^0-9A-Za-z]*[0-9]+[^0-9A-Za-z]*$"


def any_of(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text (as it is, no word bounds)."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def first_of(text: Column, pairs: list[tuple[str, object]]) -> Column:
    """The value of the first pair whose word stands in the text."""
    out = F
    for word, value in pairs:
        out = out.when(F.contains(text, F.lit(word)), F.lit(value))
    return out


def snippet(text: Column, term: Column, lines: int = 3, width: int = 200) -> Column:
    """The first matching lines, trimmed, joined by ``; `` and cut."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    found = F.filter(trimmed, lambda x: (x != "") & F.contains(F.lower(x), F.lower(term)))
    whole = F.array_join(F.slice(found, 1, lines), "; ")
    return F.when(F.length(whole) > width, F.concat(F.left(whole, F.lit(width)), F.lit("..."))).otherwise(whole)


def sentences(text: Column, least: int = 10) -> Column:
    """Trimmed sentences of more than ``least`` characters."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) > least)


def normal_name(name: Column) -> Column:
    """Lower case, separators as spaces, single spaces."""
    out = F.trim(F.lower(name))
    for s in d.SEPARATORS:
        out = F.replace(out, F.lit(s), F.lit(" "))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def strip_prefix(name: Column, prefixes: list[str]) -> Column:
    """The name without the first prefix that it starts with."""
    out = F
    for p in prefixes:
        out = out.when(F.startswith(name, F.lit(p)), F.substring(name, len(p) + 1, 1_000_000))
    return out.otherwise(name) if prefixes else name


def clean_cell(cell: Column) -> Column:
    """Null as the empty text, white space as single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


def whole_number(text: Column) -> Column:
    """The text as a long, null where it is none.  A cast that fails costs an exception, so texts of another shape aren't cast."""
    return F.when(F.rlike(text, F.lit(DIGITS)), text.try_cast("long"))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def percentage(text: Column) -> Column:
    return F.coalesce(
        _number(text, PERCENT_SIGN), _number(F.lower(text), PERCENT_WORD)
    )


def hedge_ratio(text: Column) -> Column:
    full = any_of(F.lower(text), ["fully hedged", "full hedge"])
    return F.when(full, F.lit(100.0)).otherwise(_number(text, PERCENT_SIGN))


def amount(text: Column) -> tuple[Column, Column]:
    """Amount and currency: currency first, else amount first."""
    leads = text.rlike(CURRENCY_FIRST)
    raw = F.when(leads, F.regexp_extract(text, CURRENCY_FIRST, 2)).otherwise(F.regexp_extract(text, AMOUNT_FIRST, 1))
    sign = F.when(leads, F.regexp_extract(text, CURRENCY_FIRST, 1)).otherwise(F.regexp_extract(text, AMOUNT_FIRST, 2))
    money = F.when(sign == "$", "USD").when(sign == "€", "EUR").when(sign == "£", "GBP").otherwise(F.nullif(sign, F.lit("")))
    return F.nullif(F.replace(raw, F.lit(","), F.lit("")), F.lit("")).try_cast("double"), money


def days(text: Column) -> Column:
    plain = F.nullif(F.regexp_extract(F.lower(text), DAYS, 1), F.lit("")).try_cast("int")
    return F.coalesce(plain, first_of(F.lower(text), d.PERIODS).cast("int"))


def comparator(text: Column) -> Column:
    low = F.lower(text)
    return F.when(any_of(low, d.MAX_WORDS), "max").when(any_of(low, d.MIN_WORDS), "min")


def restriction(text: Column) -> Column:
    """The type of a restriction clause."""
    low = F.lower(text)
    out = F
    for kind, words in d.RESTRICTIONS.items():
        out = out.when(any_of(low, words), kind)
    return out.otherwise("asset_limit")


def clauses(text: Column) -> Column:
    """The trimmed clauses between semicolons, without empty ones."""
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")


def refers_to(cell: Column, documents: list[tuple[str, str]]) -> Column:
    """The document that a table cell refers to instead of giving a value, or null."""
    low = F.lower(F.trim(cell))
    confirmed = any_of(low, d.REFERRALS) | (F.length(low) < 30)
    usable = ~low.isin(d.PLACEHOLDERS) & (F.length(low) <= 80) & confirmed
    return F.when(usable, first_of(low, documents))


def chunk_size(pages: Column, base: int = 30) -> Column:
    """Pages a chunk for a document of so many pages."""
    return F.when(pages <= 100, base).when(pages <= 200, 25).when(pages <= 350, 20).when(pages <= 500, 15).otherwise(10)
