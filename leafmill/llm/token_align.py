"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Each tokenizer gives a text a list of byte offsets where its tokens end.  The shorter list of a text drives a *galloping
intersection*: each of its offsets starts at the place of the longer list that its share of the bytes suggests, doubles
its steps until two places hold it between them, and halves the stretch down to one place.  All offsets of a batch of
texts do so in lockstep.  Offsets in both lists are common ends.  They slice both token lists into groups of equal
bytes, and how many places lie between the ranks of a token's two ends gives the range of the other side's tokens that
it overlaps.

Links are pairs of an A and a B token that end together.  The count of a pair of ids is its number of links in the whole
corpus.  By the pigeonhole principle at most ``most_frequent`` pairs have more than one ``most_frequent``-th of all links:
these are broadcast, and every text looks its links up in them.  The links of rarer pairs are joined with their counts
by pair; none of those keys can be hot.  So counts are exact at any size and what is broadcast has a proven bound.

A is a byte-level BPE file of the tokenizers library, whose input is the text behind one space; B is a BPE model of the
sentencepiece library, which adds that space itself.  Special tokens' strings are plain text.  Null and empty texts, and
texts whose tokens of either side don't spell the text behind one space, have no tokens: zeros and an empty hash.  Each
input row gives one row, repeated rows too; other columns are not read.  The tokenizer's work and memory follow the
length of a text: B encodes it in stretches cut before runs of spaces where no piece reaches over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.bpe import Codec, _runs
from leafmill.session import in_job, materialize, read_table, ship_code

#: Pairs broadcast at most, of 17 bytes each.
MOST_FREQUENT = 500_000
#: Code points that B encodes at once, about.
STRETCH = 65_536


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """The bytes of each id of one tokenizer, and its encoder."""

    def __init__(self, names: list[bytes]) -> None:
        self.lengths = np.array([len(x) for x in names], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(names), dtype=np.uint8)
        #: Ids as text, with what may follow: a comma, a bar, a semicolon.
        self.written = np.array([f"{i}{c}" for c in ",|;" for i in range(len(names))], dtype=object)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[ids] - (ends - lengths), lengths)]


class ByteLevel(Side):
    def __init__(self, path: str) -> None:
        self.codec = Codec(path)
        self.codec.library.encode_special_tokens = True
        super().__init__(self.codec.bytes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        c = self.codec
        if c.ranked is None:
            found = c.library.encode_batch([" " + x for x in texts], add_special_tokens=False)
            return [np.array(x.ids, dtype=np.int64) for x in found]
        return [c.ranked.encode_to_numpy(" " + x, allowed_special=set(), disallowed_special=()).astype(np.int64) for x in texts]


class Pieces(Side):
    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(i) for i in ids]
        super().__init__(
            [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        )
        #: No piece has a space behind another sign, so none reaches over the start of a run of spaces.
        self.apart = not any("▁" in x.lstrip("▁") for x in names)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self._stretches(x) for x in texts]
        ids = iter(self.model.encode([y for x in cut for y in x], num_threads=1))
        return [np.array([i for _ in x for i in next(ids)], dtype=np.int64) for x in cut]

    def _stretches(self, text: str) -> list[str]:
        """Stretches whose encodings, each with the space that the model adds, make up the text's own."""
        out, at = [], 0
        while self.apart and len(text) - at > STRETCH:
            # A space behind another sign, which the model then adds itself.
            end = text.find(" ", at + STRETCH)
            while end > 0 and text[end - 1] in " ▁":
                end = text.find(" ", end + 1)
            if end < 0 or end + 1 == len(text):
                break
            out.append(text[at:end])
            at = end + 1
        return [*out, text[at:]]


@lru_cache(maxsize=2)
def sides(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


def gallop(values: np.ndarray, into: np.ndarray, low: np.ndarray, high: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each value the first place in ``into``, of low .. high - 1, that isn't smaller; else high.

    ``into`` ascends from low to high - 1 and guesses lie there (or low = high).  Every value starts at its guess, steps
    away by 1, 2, 4, ... until it is enclosed, and halves what is left.
    """
    left, right = low - 1, high.copy()  # into[left] < value <= into[right]; both may stand outside
    if not len(into):
        return right
    at = np.clip(guess, low, np.maximum(high - 1, low))
    step = 1
    inside = low < high
    going = np.flatnonzero(inside)
    smaller = np.zeros(len(values), dtype=bool)
    smaller[going] = into[at[going]] < values[going]
    left[smaller] = at[smaller]
    up = inside & ~smaller
    right[up] = at[up]
    while len(going):
        place = np.where(smaller[going], at[going] + step, at[going] - step)
        within = (place > left[going]) & (place < right[going])
        going, place = going[within], place[within]
        less = into[place] < values[going]
        left[going[less]] = place[less]
        right[going[~less]] = place[~less]
        going = going[less == smaller[going]]
        step *= 2
    going = np.flatnonzero(right - left > 1)
    while len(going):
        middle = (left[going] + right[going]) >> 1
        less = into[middle] < values[going]
        left[going[less]] = middle[less]
        right[going[~less]] = middle[~less]
        going = going[right[going] - left[going] > 1]
    return right


class Aligned:
    """The alignment of the tokens of some texts, side by side.

    ``a`` and ``b`` are the ids of all texts; ``a_at``, ``b_at`` where each text's ids start (one more than texts);
    ``a_ends``, ``b_ends`` byte offsets in all texts together.  ``common_a`` and ``common_b`` are the places of the tokens
    that end together, ``group_at`` where each text's groups start.
    """

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], left: Side, right: Side) -> None:
        self.left, self.right = left, right
        self.n_a, self.n_b = (np.array([len(x) for x in y], dtype=np.int64) for y in (a, b))
        none = [np.zeros(0, dtype=np.int64)]
        self.a, self.b = np.concatenate([*a, *none]), np.concatenate([*b, *none])
        self.a_at, self.b_at = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        self.a_ends, self.b_ends = np.cumsum(left.lengths[self.a]), np.cumsum(right.lengths[self.b])
        text_of_a = np.repeat(np.arange(len(a)), self.n_a)
        text_of_b = np.repeat(np.arange(len(b)), self.n_b)
        shorter_a = self.n_a <= self.n_b
        places_a = self._common(self.a_ends, text_of_a, shorter_a, self.a_at, self.b_ends, self.b_at)
        places_b = self._common(self.b_ends, text_of_b, ~shorter_a, self.b_at, self.a_ends, self.a_at)
        ia, ib = np.concatenate([places_a[0], places_b[1]]), np.concatenate([places_a[1], places_b[0]])
        order = np.argsort(ia, kind="stable")
        self.common_a, self.common_b = ia[order], ib[order]
        self.group_at = np.searchsorted(self.common_a, self.a_at)

    @staticmethod
    def _common(ends, text, driving, at, into, into_at) -> tuple[np.ndarray, np.ndarray]:
        """Places of the common ends in the driving list and in the other, for texts whose list drives."""
        mine = np.flatnonzero(driving[text])
        text = text[mine]
        low, high = into_at[text], into_at[text + 1]
        # The place in the longer list that the rank in the shorter one suggests.
        rank, n = mine - at[text], np.maximum(at[text + 1] - at[text], 1)
        found = gallop(ends[mine], into, low, high, low + rank * (high - low) // n)
        hit = np.flatnonzero(found < high)
        hit = hit[into[found[hit]] == ends[mine[hit]]]
        return mine[hit], found[hit]

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """For each A token the first B token that shares a byte with it and the one behind the last, as places in ``b``."""
        ends = self.a_ends
        starts = ends - self.left.lengths[self.a]
        text = np.repeat(np.arange(len(self.n_a)), self.n_a)
        low, high = self.b_at[text], self.b_at[text + 1]
        rank, n = np.arange(len(ends)) - self.a_at[text], np.maximum(self.n_a[text], 1)
        guess = low + rank * (high - low) // n
        first = gallop(starts + 1, self.b_ends, low, high, guess)
        return first, np.minimum(gallop(ends, self.b_ends, low, high, guess) + 1, high)

    def written(self) -> list[str]:
        """Each text's groups: ``a1,a2|b1;a3|b2,b3``."""
        n = len(self.a)
        size_a, size_b = len(self.left.lengths), len(self.right.lengths)
        sign_a, sign_b = np.zeros(n, dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        sign_a[self.common_a], sign_b[self.common_b] = 1, 2
        # An A token comes behind the B tokens of the groups before its own, a B token behind the A tokens up to its own.
        group_a = np.searchsorted(self.common_a, np.arange(n))
        group_b = np.searchsorted(self.common_b, np.arange(len(self.b)))
        before_a = np.concatenate([[0], self.common_b + 1])[group_a]
        before_b = (self.common_a + 1)[group_b]
        out = np.empty(n + len(self.b), dtype=object)
        out[np.arange(n) + before_a] = self.left.written[self.a + size_a * sign_a]
        out[np.arange(len(self.b)) + before_b] = self.right.written[self.b + size_b * sign_b]
        at = self.a_at + self.b_at
        parts = out.tolist()
        return ["".join(parts[x:y])[:-1] for x, y in zip(at[:-1], at[1:], strict=True)]


def _encoded(texts: list[str | None], left: Side, right: Side) -> Aligned:
    """The alignment of texts; those that either side spells otherwise have no tokens."""
    told = [x for x in texts if x]
    pairs = zip(told, left.encode(told), right.encode(told), strict=True)
    none = np.zeros(0, dtype=np.int64)
    good = []
    for text, a, b in pairs:
        raw = np.frombuffer(b" " + text.encode(), dtype=np.uint8)
        same = all(np.array_equal(side.spelled(ids), raw) for side, ids in ((left, a), (right, b)))
        good.append((a, b) if same else (none, none))
    given = iter(good)
    both = [next(given) if x else (none, none) for x in texts]
    return Aligned([x for x, _ in both], [y for _, y in both], left, right)


def align(docs: DataFrame, a: str, b: str, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256 and the distinct linked pairs of every row.

    ``pairs`` is binary: pairs as little-endian 64-bit integers (A's id, times 2^32, plus B's), ascending, and ``times``
    their numbers as 32-bit ones.  Every token but an empty one ends at its own offset, so a group has one link.
    """
    ship_code(docs.sparkSession)
    slim = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = sides(a, b)
        for batch in batches:
            texts = batch.column("text")
            for x, y in _runs(texts):
                found = _encoded(texts[x:y].to_pylist(), left, right)
                codes = (found.a[found.common_a] << 32) + found.b[found.common_b]
                at = found.group_at
                told = [np.unique(codes[i:j], return_counts=True) for i, j in zip(at[:-1], at[1:], strict=True)]
                groups = np.diff(at)
                hashes = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in found.written()]
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").slice(x, y - x), "n_a": pa.array(found.n_a), "n_b": pa.array(found.n_b),
                    "n_groups": pa.array(groups), "n_links": pa.array(groups), "groups_sha256": pa.array(hashes, pa.string()),
                    "pairs": pa.array([p.astype("<i8").tobytes() for p, _ in told], pa.binary()),
                    "times": pa.array([t.astype("<i4").tobytes() for _, t in told], pa.binary()),
                })

    return slim.mapInArrow(
        run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    ).withColumnRenamed("id", id_)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the batch, pair and number of all pairs of a batch."""
    pairs = [np.frombuffer(x, dtype="<i8") for x in batch.column("pairs").to_pylist()]
    times = [np.frombuffer(x, dtype="<i4") for x in batch.column("times").to_pylist()]
    row = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
    return row, np.concatenate([*pairs, np.zeros(0, dtype="<i8")]), np.concatenate([*times, np.zeros(0, dtype="<i4")]).astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): the number of links of each pair of ids in the corpus, and whether it is the most of its B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums of one task: pairs that it has met, at most the pairs of both vocabularies.
        held, sums, waiting, n_waiting = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), [], 0

        def merged():
            pairs = np.concatenate([held, *(p for p, _ in waiting)])
            times = np.concatenate([sums, *(t for _, t in waiting)])
            distinct, place = np.unique(pairs, return_inverse=True)
            return distinct, np.bincount(place, weights=times, minlength=len(distinct)).astype(np.int64)

        for batch in batches:
            _, pairs, times = _flat(batch)
            waiting.append((pairs, times))
            n_waiting += len(pairs)
            if n_waiting > 1_000_000:
                held, sums = merged()
                waiting, n_waiting = [], 0
            if len(held) > 2_000_000:
                yield pa.RecordBatch.from_pydict({"pair": pa.array(held), "n": pa.array(sums)})
                held, sums = held[:0], sums[:0]
        held, sums = merged()
        yield pa.RecordBatch.from_pydict({"pair": pa.array(held), "n": pa.array(sums)})

    counts = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "pairs")
    b = F.expr("pair & 4294967295")
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B
    return counts.join(most, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, id_: str = "doc_id", most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """``aligned`` rows with ``n_best`` (links whose count is the most of their B id's) and ``count_sum`` (over links)."""
    session = aligned.sparkSession
    ship_code(session)
    # The id is given out as the rows are written, so it stays the same whatever is run again.
    aligned = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(aligned), "pair-counts")
    links = counts.agg(F.sum("n")).first()[0] or 0
    # No more than most_frequent pairs can have more links than that.
    bound = links // most_frequent
    table = counts.where(F.col("n") > bound).toArrow().combine_chunks()
    order = np.argsort(table["pair"].to_numpy())
    known = session.sparkContext.broadcast((
        table["pair"].to_numpy()[order], table["n"].to_numpy()[order], table["best"].to_numpy(zero_copy_only=False)[order],
    ))

    def looked_up(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = known.value[0]
        if not len(keys):
            return np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=bool)
        place = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        return place, keys[place] == pairs

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pairs, times = _flat(batch)
            place, hit = looked_up(pairs)
            row, place, times = row[hit], place[hit], times[hit]
            sums, best = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(sums, row, times * known.value[1][place])
            np.add.at(best, row, times * known.value[2][place])
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "n_best": pa.array(best), "count_sum": pa.array(sums)})

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pairs, times = _flat(batch)
            left = ~looked_up(pairs)[1]
            ids = batch.column("row").to_numpy()[row[left]]
            yield pa.RecordBatch.from_pydict({"row": pa.array(ids), "pair": pa.array(pairs[left]), "times": pa.array(times[left])})

    slim = aligned.select("row", "pairs", "times")
    sums = slim.mapInArrow(frequent, "row long, n_best long, count_sum long")
    if bound:
        seldom = slim.mapInArrow(rare, "row long, pair long, times long").join(counts.where(F.col("n") <= bound), "pair")
        sums = sums.unionByName(
            seldom.groupBy("row").agg(
                F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
            )
        )
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    told = aligned.drop("pairs", "times").join(sums, "row")
    return told.select(id_, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_align(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return in_job("alignment", lambda: with_counts(align(docs, *paths())))
