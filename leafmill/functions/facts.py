"""One fact meets another: which is known from then on, and why."""

from __future__ import annotations

from typing import NamedTuple

from leafmill.functions.dictionaries import RELIABILITY

REASONS = ("by_confidence", "by_source", "by_page", "by_default")
# How reliable an unknown source is, and what differences settle a conflict.
UNKNOWN, CONFIDENCE_GAP, SOURCE_GAP, PAGE_GAP = 0.3, 0.3, 0.15, 10


class Fact(NamedTuple):
    ord: int
    at: int
    value: str | None
    confidence: float
    page: int
    source: str | None


class Known(NamedTuple):
    value: str | None
    confidence: float
    page: int
    source: str | None
    by_confidence: int = 0
    by_source: int = 0
    by_page: int = 0
    by_default: int = 0


def fold(known: Known | None, fact: Fact) -> tuple[Known, str]:
    """The fact known after another has come, and why: first, same, or the rule that settled a conflict."""
    if known is None:
        return Known(fact.value, fact.confidence, fact.page, fact.source), "first"
    # A null confidence, page or value decides nothing: comparisons with it are false, as in SQL.
    gap = None if fact.confidence is None or known.confidence is None else fact.confidence - known.confidence
    rank = RELIABILITY.get(fact.source, UNKNOWN) - RELIABILITY.get(known.source, UNKNOWN)
    later = fact.page is not None and known.page is not None and fact.page > known.page + PAGE_GAP
    if fact.value is not None and fact.value == known.value:
        why, take = "same", gap is not None and gap > 0
    elif gap is not None and abs(gap) > CONFIDENCE_GAP:
        why, take = "by_confidence", gap > 0
    elif abs(rank) > SOURCE_GAP:
        why, take = "by_source", rank > 0
    else:
        why, take = "by_page" if later else "by_default", True
    if take:
        sure = max((x for x in (known.confidence, fact.confidence) if x is not None), default=None)
        known = known._replace(value=fact.value, confidence=sure, page=fact.page)
    return (known if why == "same" else known._replace(**{why: getattr(known, why) + 1})), why
