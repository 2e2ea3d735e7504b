"""Quality rules as a short-circuit cascade.

Each rule says from a text's statistics whether it rejects it.  On a bounded sample the cascade measures what each
statistic costs and which rules reject which texts together.  It then places the rules one by one: next comes the one
that rejects most of the texts that the placed ones leave, per cost of the statistics that these haven't paid for yet.
A text that one rule rejects is not looked at by the later ones, and a statistic that only they need is not worked out
for it.  The order changes the work, never the verdict.

Statistics (whole texts; a word is ``[^\\x20\\x09-\\x0D]+``): n_words, word_chars (code points in words), n_symbols
(characters of ``#*$%&|<>``), n_upper and n_letters (ASCII), n_lines (lines with a word), n_dup_lines (such lines
equal to an earlier one), n_doubled (words equal to the one before), n_repeat_words (words inside an 8-word window that
occurs twice or more in the text).  Words, lines and windows are compared by 64-bit hashes.  A text needs about 35 bytes
of worker memory for each of its bytes.

Null and empty texts have 0 in every statistic and are rejected for having too few words.  Every input row gives
one row; repeated rows give repeated rows; other columns of the input are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.shingles import IN_WORD, mix, parts, roll, runs, span_hashes
from leafmill.session import ship_code

Stats = dict[str, np.ndarray]
WINDOW = 8


class Chunk:
    """Neighbouring texts as bytes; statistics are worked out once, when a rule asks for them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self._words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.have: Stats = {}

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._words is None:
            starts, ends = runs(IN_WORD[self.data], self.offsets)
            self._words = starts, ends, np.searchsorted(starts, self.offsets)
        return self._words

    def get(self, name: str) -> np.ndarray:
        if name not in self.have:
            self.have |= STATISTICS[name](self)
        return self.have[name]

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        total = np.zeros(len(marks) + 1, dtype=np.int64)
        np.cumsum(marks, out=total[1:])
        return np.diff(total[self.offsets])

    def only(self, rows: np.ndarray) -> Chunk:
        """The same for some of the texts, with the statistics that are there already."""
        lengths = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        kept = np.zeros(len(self.data) + 1, dtype=np.int8)
        np.add.at(kept, self.offsets[:-1][rows], 1)
        np.add.at(kept, self.offsets[1:][rows], -1)
        out = Chunk(self.data[np.cumsum(kept[:-1]) > 0], offsets)
        out.have = {k: v[rows] for k, v in self.have.items()}
        return out


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_SYMBOL, _UPPER = _table(b"#*$%&|<>"), _table(bytes(range(65, 91)))
_LETTER = _UPPER | _table(bytes(range(97, 123)))


def _count_words(c: Chunk) -> Stats:
    return {"n_words": np.diff(c.words()[2])}


def _count_characters(c: Chunk) -> Stats:
    return {"word_chars": c.per_text(IN_WORD[c.data] & ((c.data & 0xC0) != 0x80))}


def _count_symbols(c: Chunk) -> Stats:
    return {"n_symbols": c.per_text(_SYMBOL[c.data])}


def _count_letters(c: Chunk) -> Stats:
    return {"n_upper": c.per_text(_UPPER[c.data]), "n_letters": c.per_text(_LETTER[c.data])}


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of these aren't the first."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    later, twice = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def _count_lines(c: Chunk) -> Stats:
    starts, ends = runs(c.data != 10, c.offsets)
    words = c.words()[0]
    filled = np.searchsorted(words, starts) < np.searchsorted(words, ends)
    starts, ends = starts[filled], ends[filled]
    first = np.searchsorted(starts, c.offsets)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, later = _repeats(span_hashes(c.data, starts, ends, fold=False) ^ mix(text.astype(np.uint64)))
    return {"n_lines": np.diff(first), "n_dup_lines": np.bincount(text[later], minlength=len(first) - 1)}


def _count_doubled(c: Chunk) -> Stats:
    starts, ends, first = c.words()
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    words = span_hashes(c.data, starts, ends, fold=False)
    same = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    return {"n_doubled": np.bincount(text[1:][same], minlength=len(first) - 1)}


def _count_repeats(c: Chunk) -> Stats:
    starts, ends, first = c.words()
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    windows = roll(span_hashes(c.data, starts, ends, fold=False), WINDOW)
    inside = np.flatnonzero(text[: len(windows)] == text[WINDOW - 1 :]) if len(windows) else np.zeros(0, dtype=np.int64)
    twice, _ = _repeats(windows[inside] ^ mix(text[inside].astype(np.uint64)))
    cover = np.zeros(len(starts) + WINDOW + 1, dtype=np.int64)
    np.add.at(cover, inside[twice], 1)
    np.add.at(cover, inside[twice] + WINDOW, -1)
    covered = np.cumsum(cover)[: len(starts)] > 0
    return {"n_repeat_words": np.bincount(text[covered], minlength=len(counts))}


STATISTICS: dict[str, Callable[[Chunk], Stats]] = {
    "n_words": _count_words,
    "word_chars": _count_characters,
    "n_symbols": _count_symbols,
    **dict.fromkeys(("n_upper", "n_letters"), _count_letters),
    **dict.fromkeys(("n_lines", "n_dup_lines"), _count_lines),
    "n_doubled": _count_doubled,
    "n_repeat_words": _count_repeats,
}


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Callable[[str], np.ndarray]], np.ndarray]


BASE_RULES = (
    Rule("few_words", lambda s: s("n_words") < 20),
    Rule("repeated_words", lambda s: 100 * s("n_repeat_words") > 30 * s("n_words")),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda s: 10 * s("n_symbols") > 3 * s("n_words")),
    Rule("word_length", lambda s: (s("word_chars") < 2 * s("n_words")) | (s("word_chars") > 16 * s("n_words"))),
    Rule("upper_case", lambda s: 2 * s("n_upper") > s("n_letters")),
    Rule("repeated_lines", lambda s: (s("n_dup_lines") >= 3) & (2 * s("n_dup_lines") > s("n_lines"))),
    Rule("doubled_words", lambda s: 10 * s("n_doubled") > 3 * s("n_words")),
)


class Measured(NamedTuple):
    """What a sample says: seconds of each counting function, and how many texts each set of rules rejects."""

    costs: dict[str, float]
    rejected: dict[frozenset[str], int]


def needs(rule: Rule) -> list[str]:
    """The names of the counting functions that a rule asks for."""
    asked: list[str] = []

    def get(name: str) -> np.ndarray:
        asked.append(STATISTICS[name].__name__)
        return np.zeros(0, dtype=np.int64)

    rule.rejects(get)
    return list(dict.fromkeys(asked))


def measure(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 2000) -> Measured:
    """Costs and joint rejections on a random sample of about ``sample_rows`` rows."""
    ship_code(docs.sparkSession)
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.sample(False, share, seed=7).select(F.col(text).alias("text"))
    counting = {f.__name__: f for f in STATISTICS.values()}
    asked = sorted({name for rule in rules for name in needs(rule)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in parts(batch.column("text")):
                chunk = Chunk(data, offsets)
                chunk.words()  # shared by most of them
                told = []
                for name in asked:
                    began = time.perf_counter()
                    chunk.have |= counting[name](chunk)
                    told.append((name, time.perf_counter() - began, 0))
                together = np.zeros(len(offsets) - 1, dtype=np.int64)
                for k, rule in enumerate(rules):
                    together |= rule.rejects(chunk.get).astype(np.int64) << k
                told += [(str(x), 0.0, n) for x, n in zip(*(y.tolist() for y in np.unique(together, return_counts=True)), strict=True)]
                yield pa.RecordBatch.from_pydict(dict(zip("xsn", map(list, zip(*told, strict=True)), strict=True)))

    found = sample.mapInArrow(run, "x string, s double, n long").groupBy("x").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    costs, rejected = {}, {}
    for r in found.collect():  # a row for each function and each set of rules that reject a text together
        if r["x"] in counting:
            costs[r["x"]] = r["s"]
        else:
            rejected[frozenset(rule.name for k, rule in enumerate(rules) if int(r["x"]) >> k & 1)] = r["n"]
    return Measured(costs, rejected)


def order(rules, measured: Measured) -> tuple:
    """The rules by what they reject of the texts left, per cost not yet paid; where that is equal, as given.

    Costs count in powers of two, so the order doesn't follow small changes of the clock.
    """
    placed: list[Rule] = []
    paid: set[str] = set()
    left = list(rules)
    while left:
        gone = {r.name for r in placed}

        def worth(rule: Rule, gone=gone) -> float:
            gain = sum(n for names, n in measured.rejected.items() if rule.name in names and not names & gone)
            cost = sum(measured.costs.get(x, 1.0) for x in needs(rule) if x not in paid)
            return gain / 2.0 ** np.ceil(np.log2(max(cost, 1e-6)))

        best = max(left, key=worth)
        placed.append(best)
        left.remove(best)
        paid |= set(needs(best))
    return tuple(placed)


def cascade(
    docs: DataFrame, rules=RULES, text: str = "text", id_: str = "doc_id", sample_rows: int = 2000,
    report: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: the id, ``kept``, ``rejected_by`` (the first rule in the measured order, or null).

    Statistics named in ``report`` are returned for every text, so their cost is not spared.
    """
    ship_code(docs.sparkSession)
    ranked = order(rules, measure(docs, rules, text, sample_rows))
    slim = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in parts(batch.column("text")):
                n = len(offsets) - 1
                chunk = Chunk(data, offsets)
                told = {name: chunk.get(name) for name in report}
                by = np.full(n, -1, dtype=np.int8)
                rows = np.arange(n)
                for k, rule in enumerate(ranked):
                    rejected = rule.rejects(chunk.get)
                    if rejected.any():
                        by[rows[rejected]] = k
                        rows = rows[~rejected]
                        chunk = chunk.only(~rejected)
                names = [None if k < 0 else ranked[k].name for k in by]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(row, n), pa.array(by < 0), pa.array(names, pa.string()),
                        *(pa.array(told[x].astype(np.int64)) for x in report),
                    ],
                    names=["id", "kept", "rejected_by", *report],
                )

    kind = slim.schema["id"].dataType.simpleString()
    stats = "".join(f", {x} long" for x in report)
    return slim.mapInArrow(run, f"id {kind}, kept boolean, rejected_by string{stats}").withColumnRenamed("id", id_)


def keep(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs``, whole, whose text no rule rejects."""
    ship_code(docs.sparkSession)
    ranked = order(rules, measure(docs, rules, text, sample_rows))
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.ones(batch.num_rows, dtype=bool)
            for row, data, offsets in parts(batch.column(column)):
                chunk, rows = Chunk(data, offsets), np.arange(row, row + len(offsets) - 1)
                for rule in ranked:
                    rejected = rule.rejects(chunk.get)
                    if rejected.any():
                        kept[rows[rejected]] = False
                        rows, chunk = rows[~rejected], chunk.only(~rejected)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    from leafmill.session import read_table

    report = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = cascade(read_table(spark, sf_dir, "documents"), report=report)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.select("doc_id", *report, failed.alias("base_failed"), "kept")
