"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled sample is drawn from all texts, labelled or not and positives
included, so that a share of it (the class prior) is toxic too.  A numpy classifier is trained on the risk

    prior * loss(positives, +) + max(0, loss(unlabelled, -) - prior * loss(positives, -))

with the logistic loss; where the bracket turns negative, the step undoes it instead, so the classifier doesn't learn
unlabelled texts by heart.

The classifier reads distinct words in folded spelling (``folding``): a word's margin is the sum of the weights of its
hashed pieces, so inflected, prefixed and disguised forms count like the plain one, and a text's margin is the logarithm
of the sum of its words' exponentials, a smooth maximum: clean text around a toxic passage doesn't hide it.  Each
step sees a random part (SEEN) of every text's words, so that of several terms that stand together each is learned.  Weights
start from how much more often a piece occurs in positives than in the unlabelled sample, in standard errors.

Training takes at most ``positives`` and ``unlabelled`` distinct texts, found among twice as many ids (the smallest by
hash), and of these as many as hold ``most_words`` distinct words in all, each half of it; nothing else bounds it.
Scoring covers every whole text.  Null and empty texts, and texts without words, score 0.  Labels that are null or
contradict one another count as unlabelled.  Without positives every score is 0.  Each input row gives one row, repeated
rows and ids too; rows with a null id are scored but not learned from; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.folding import BITS, keys, pieces, words
from leafmill.llm.rule_ensemble import labelled_sample
from leafmill.session import materialize, read_table, ship_code

POSITIVES, UNLABELLED, MOST_WORDS = 2_000, 6_000, 2_000_000
STEPS, RATE, BIAS_SHARE, MOMENTUM, DECAY = 120, 4.0, 0.05, 0.9, 1e-4
#: Weight of a piece at the start for each standard error, and where word margins are cut off.
START, HIGHEST = 0.02, 15.0
#: Share of a text's words that a step sees, other ones each time, and how many it sees at least, about: so every term of
#: a text learns, not the strongest alone.
SEEN, SEEN_WORDS = 0.4, 8


class Model(NamedTuple):
    weights: np.ndarray  # of each hashed piece
    bias: float  # of each word


def distinct_words(texts: pa.Array) -> list[list[bytes]]:
    """The distinct folded words of each text."""
    out: list[set[bytes]] = [set() for _ in range(len(texts))]
    for row, found in words(texts):
        data = found.data.tobytes()
        for a, b, k in zip(found.starts.tolist(), found.ends.tolist(), found.text.tolist(), strict=True):
            out[row + k].add(data[a:b])
    return [sorted(x) for x in out]


class Sample:
    """Training texts as numbers of distinct words, and those words as numbers of distinct pieces."""

    def __init__(self, rows: list[list[bytes]] | pa.ListArray) -> None:
        rows = rows if isinstance(rows, pa.ListArray) else pa.array(rows, pa.list_(pa.binary()))
        coded = rows.flatten().dictionary_encode()
        self.size = np.diff(rows.offsets.to_numpy())
        self.word = coded.indices.to_numpy().astype(np.int32)
        data = np.frombuffer(b" " + b" ".join(coded.dictionary.to_pylist()) + b" ", dtype=np.uint8)
        starts = np.flatnonzero((data[1:] != 32) & (data[:-1] == 32)) + 1
        at, hashed = (np.concatenate(x) for x in zip(*pieces(data, starts), strict=True))
        order = np.argsort(at, kind="stable")
        self.pieces, self.piece = np.unique(hashed[order], return_inverse=True)
        self.piece = self.piece.astype(np.int32)
        self.spelled = np.bincount(at, minlength=len(starts))  # pieces of each word, one at least

    def word_sums(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.piece], np.cumsum(self.spelled) - self.spelled)

    def text_sums(self, of_words: np.ndarray, seen: np.ndarray | float = 1.0) -> np.ndarray:
        return np.add.reduceat(of_words[self.word] * seen, np.cumsum(self.size) - self.size)

    def by_word(self, of_texts: np.ndarray, seen: np.ndarray | float = 1.0) -> np.ndarray:
        return np.bincount(self.word, np.repeat(of_texts, self.size) * seen, minlength=len(self.spelled))

    def by_piece(self, of_words: np.ndarray) -> np.ndarray:
        return np.bincount(self.piece, np.repeat(of_words, self.spelled), minlength=len(self.pieces))


def learn(sample: Sample, positive: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """The model, from texts with one word at least and which of them are positives (some, and not all)."""
    n_p, n_u = positive.sum(), (~positive).sum()
    in_p = sample.by_piece(sample.by_word(positive / n_p))
    in_u = sample.by_piece(sample.by_word(~positive / n_u))
    weights = START * np.maximum(0, (in_p - in_u) / np.sqrt(in_p / n_p + in_u / n_u + 1 / n_p**2))
    start = np.log(sample.text_sums(np.exp(np.minimum(sample.word_sums(weights), HIGHEST))))
    bias = np.log(prior / max(1 - prior, 1e-9)) - np.median(start[~positive])
    moved, bias_moved = np.zeros_like(weights), 0.0
    rng = np.random.default_rng(5)
    share = np.repeat(np.maximum(SEEN, np.minimum(1, SEEN_WORDS / sample.size)), sample.size).astype(np.float32)
    for _ in range(steps):
        of_word = np.exp(np.minimum(sample.word_sums(weights) + bias, HIGHEST))
        seen = (rng.random(len(sample.word), dtype=np.float32) < share).astype(np.float64)
        total = sample.text_sums(of_word, seen) + 1e-12  # a text of which no word is seen
        chance = total / (1 + total)
        # loss(m, +) = log(1 + exp(-m)) and loss(m, -) = log(1 + exp(m)), with exp(m) = total; their difference is m.
        against = np.log1p(total)
        if against[~positive].mean() >= prior * against[positive].mean():
            slope = np.where(positive, -prior / n_p, chance / n_u)
        else:
            slope = np.where(positive, prior * chance / n_p, -chance / n_u)
        by_word = sample.by_word(slope / total, seen) * of_word
        moved = MOMENTUM * moved + sample.by_piece(by_word) + DECAY * weights
        bias_moved = MOMENTUM * bias_moved + by_word.sum()
        weights = weights - RATE * moved
        bias -= RATE * BIAS_SHARE * bias_moved
    out = np.zeros(1 << BITS, dtype=np.float32)
    out[sample.pieces] = weights
    return Model(out, float(bias))


def _chosen(found: pa.Table, positives: int, unlabelled: int, most_words: int) -> list[tuple[int, int]]:
    """(hash, y) of the texts to train on: distinct ones in the order of their hashes, as many as the bounds allow."""
    out = []
    for y, rows in ((1, positives), (0, unlabelled)):
        of = found.filter(pa.compute.equal(found["y"], y))
        hashes, first = np.unique(of["h"].to_numpy(), return_index=True)
        sizes = of["n"].to_numpy()[first]
        left = most_words // 2
        taken = 0
        for h, n in zip(hashes.tolist(), sizes.tolist(), strict=True):
            if taken < rows and n <= left:
                out.append((h, y))
                taken, left = taken + 1, left - n
    return out


def train(
    docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, label: str = "toxic", text: str = "text",
    id_: str = "doc_id", positives: int = POSITIVES, unlabelled: int = UNLABELLED, most_words: int = MOST_WORDS,
    prior: float | None = None,
) -> Model:
    """Fit on rows of ``may_learn`` (a condition on the id column; all if None); the prior is the labels' share of 1 unless given."""
    spark = docs.sparkSession
    ship_code(spark)
    if may_learn is not None:
        docs, labels = docs.where(may_learn), labels.where(may_learn)
    if prior is None:
        prior = labels.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    none = Model(np.zeros(1 << BITS, dtype=np.float32), -np.inf)
    agreed = labels.groupBy(id_).agg(F.min(label).alias(label), F.max(label).alias("most")).where(F.col(label) == F.col("most"))
    toxic = labelled_sample(agreed.where(F.col(label) == 1), label, id_, 2 * positives)
    others = docs.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"))
    others = others.orderBy(F.xxhash64("id", F.lit("unlabelled")), "id").limit(2 * unlabelled).distinct()
    # At most 2 * (positives + unlabelled) ids: the broadcast is bounded.
    chosen = toxic.select("id", F.lit(1).alias("y")).unionByName(others.withColumn("y", F.lit(0)))
    some = docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(distinct_words(batch.column("text")), pa.list_(pa.binary()))
            n = pa.compute.list_value_length(found).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), n, found], names=["id", "y", "h", "n", "words"])

    kind = some.schema["id"].dataType.simpleString()
    hashed = some.select("id", "y", F.xxhash64("text").alias("h"), "text")
    held = materialize(hashed.mapInArrow(run, f"id {kind}, y int, h long, n long, words array<binary>"), "words").where("n > 0")
    # One text an id, so a repeated id doesn't swell what comes to the driver.
    texts = held.groupBy("id", "y").agg(F.min(F.struct("h", "n")).alias("t")).select("y", "t.h", "t.n").toArrow()
    taken = _chosen(texts, positives, unlabelled, most_words)
    if not any(y for _, y in taken) or all(y for _, y in taken) or not prior:
        return none
    rows = held.join(F.broadcast(spark.createDataFrame(taken, "h long, y int")), ["h", "y"])
    rows = rows.groupBy("h", "y").agg(F.first("words").alias("words")).toArrow().sort_by([("y", "ascending"), ("h", "ascending")])
    return learn(Sample(rows["words"].combine_chunks()), rows["y"].to_numpy() == 1, prior)


def text_scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Score of each text."""
    out = np.zeros(len(texts))
    seen: list[np.ndarray] = []  # words of the stretches of one long text
    last = -1
    for row, found in words(texts):
        margin = np.full(len(found.starts), model.bias)
        for at, hashed in pieces(found.data, found.starts):
            margin += np.bincount(at, model.weights[hashed], minlength=len(margin))
        key = keys(found)
        order = np.lexsort((key, found.text))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (found.text[order][1:] != found.text[order][:-1])
        order = order[new]
        if row == last:  # a further stretch of one long text
            order = order[~np.isin(key[order], np.concatenate(seen))]
            seen.append(key[order])
        else:
            seen, last = [key[order]], row
        total = np.bincount(found.text[order], np.exp(np.minimum(margin[order], HIGHEST)))
        out[row : row + len(total)] += total
    return out / (1 + out)


def score(docs: DataFrame, model: Model, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id and ``score`` (0 to 1) of every row."""
    spark = docs.sparkSession
    ship_code(spark)
    slim = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(model)  # 4 MB at any size of the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(text_scores(batch.column("text"), Model(*shared.value)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), scores], names=["id", "score"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_)


def op6_pu_toxicity(spark, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
