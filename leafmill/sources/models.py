"""Model steps behind one interface, with a replay of stored answers.

A step is a table of prompts (stage, key, prompt); a backend turns it into answers (stage, key, json).  The replay backend
joins stored answers, so every run without a network gives the same rows; prompts without an answer give null, and the
rules next to each step take over.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Backend(Protocol):
    def answer(self, prompts: DataFrame) -> DataFrame: ...


class Replay:
    """Answers from a table of (stage, key, json)."""

    def __init__(self, stored: DataFrame) -> None:
        self.stored = stored.groupBy("stage", "key").agg(F.min("json").alias("json"))

    def answer(self, prompts: DataFrame) -> DataFrame:
        return prompts.join(self.stored, ["stage", "key"], "left")


NOTES = (
    "page_start int, page_end int, toc_pages array<int>, umbrella_info_pages array<int>, "
    "funds_mentioned array<struct<name: string, page: int, has_dedicated_section: boolean>>, "
    "tables array<struct<table_type: string, page_start: int, page_end: int, columns: array<string>, has_fund_name_column: boolean, belongs_to_fund: string>>, "
    "cross_references array<struct<text: string, source_page: int, target_description: string, is_external: boolean, external_doc: string, field_hint: string, target_pages: array<int>>>, "
    "observations array<string>, page_index array<struct<page: int, content_type: string, fund_name: string, description: string>>"
)


def notes(answers: DataFrame) -> DataFrame:
    """Answers of the exploring step as structs; text that is no such JSON gives empty notes."""
    return answers.withColumn("notes", F.from_json("json", NOTES))


def mentions(noted: DataFrame) -> DataFrame:
    """(key, name, page, dedicated, ord) of every name mentioned."""
    told = noted.select("key", F.posexplode("notes.funds_mentioned").alias("ord", "m"))
    return told.select("key", "m.name", "m.page", F.col("m.has_dedicated_section").alias("dedicated"), "ord")
