"""BPE encoding and decoding, equal to the tokenizers library, with long texts joined as a tree.

Three levels, each exact:

* A text with a long unsplit stretch is cut before every single space that a letter, digit or ASCII sign follows.  The
  byte-level pre-tokenizer starts a new piece there whatever stands before, so these segments can be encoded apart.
* A segment of more than UNSPLIT_CHARS code points is *tree-concatenated*: halves are encoded on their own; around each join a window of
  tokens is encoded anew and grows until it agrees with both sides on ``AGREE`` tokens (or reaches their ends).
  A BPE sequence in which all neighbours are valid together is the encoding, so the rest of both halves stands.
* A text of more than ``piece_chars`` code points is dealt out as pieces, encoded by different tasks, and its pieces
  are joined pairwise in the same way.

Null and empty texts have no tokens and decode to the empty text.  Each input row gives one row, repeated rows too;
other columns of the input are not read.  The vocabulary file's path is a parameter; it must be a byte-level BPE
without normalizer, prefix space or post-processor, which is checked.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.session import read_table, ship_code

UNSPLIT_CHARS = 4_096
PIECE_CHARS = 65_536
AGREE = 4
#: Fixed value: how the byte-level pre-tokenizer splits.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows are handed back in batches of about so many bytes.
BATCH_BYTES = 2_000_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_by_letter() -> dict[str, int]:
    """Byte-level alphabets write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _segments(text: str) -> list[str]:
    """Cut before single spaces that a letter, digit or sign follows; all but the first lack that space."""
    found = text.split(" ")
    if all(map(_opens, found[1:])):
        return found
    out = found[:1]
    for x in found[1:]:
        if _opens(x):
            out.append(x)
        else:
            out[-1] += " " + x
    return out


def _opens(x: str) -> bool:
    return x[:1].isalnum() or "!" <= x[:1] <= "~"


class Vocabulary:
    """What each id stands for; enough for decoding."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["post_processor"] or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        letters = _bytes_by_letter()
        self.added = {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        known = {i: bytes(letters[c] for c in x) for x, i in spec["model"]["vocab"].items() if i not in self.added}
        known |= self.added
        self.bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.lengths = np.array([len(x) for x in self.bytes], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        places = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.flat[places].tobytes()


class Codec(Vocabulary):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # Where ids are ranks, as in files of this family, the rank encoder gives the same ids some times faster.
        ranks = {x: i for i, x in enumerate(self.bytes) if x and i not in self.added}
        merged = [self.library.token_to_id(a + b) for a, b in self.merges]
        self.ranked = None
        if merged == list(range(256, 256 + len(merged))) and len(ranks) == 256 + len(merged):
            special = {x.decode(): i for i, x in self.added.items()}
            self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def plain(self, text: str) -> np.ndarray:
        if self.ranked is not None:
            return self.ranked.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def concatenate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The encoding of two neighbouring stretches from the encoding of each."""
        if not len(a) or not len(b):
            return a if len(a) else b
        k = 8 * AGREE
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            try:
                window = self.plain((self.raw(a[i:]) + self.raw(b[:j])).decode("utf-8"))
            except UnicodeDecodeError:  # an end inside a character
                k += 1
                continue
            left = i == 0 or np.array_equal(window[:AGREE], a[i : i + AGREE])
            right = j == len(b) or np.array_equal(window[-AGREE:], b[j - AGREE : j])
            if left and right:
                return np.concatenate([a[:i], window, b[j:]])
            k *= 2

    def tree(self, text: str, leaf: int = UNSPLIT_CHARS) -> np.ndarray:
        if len(text) <= leaf:
            return self.plain(text)
        middle = len(text) // 2
        return self.concatenate(self.tree(text[:middle], leaf), self.tree(text[middle:], leaf))

    def join(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Pieces in order, joined pairwise, level by level."""
        while len(pieces) > 1:
            pairs = [self.concatenate(a, b) for a, b in zip(pieces[::2], pieces[1::2], strict=False)]
            pieces = pairs + ([pieces[-1]] if len(pieces) % 2 else [])
        return pieces[0] if pieces else np.zeros(0, dtype="<u4")

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text, however long its unsplit stretches are."""
        if len(text) <= UNSPLIT_CHARS or max(map(len, text.split(" "))) <= UNSPLIT_CHARS:
            return self.plain(text)
        found, short = [], []
        for k, x in enumerate(_segments(text)):
            x = " " + x if k else x
            if len(x) > UNSPLIT_CHARS:
                found += [self.plain("".join(short)), self.tree(x)]
                short = []
            else:
                short.append(x)
        return np.concatenate([*found, self.plain("".join(short))])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [self.whole(x).tobytes() for x in texts]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows of about BATCH_BYTES bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    start = 0
    while start < len(texts):
        before = int(sizes[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, side="right")))
        yield start, end
        start = end


def encode(
    docs: DataFrame, path: str, text: str = "text", id_: str = "doc_id", piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """id, ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens`` of every row's whole text."""
    ship_code(docs.sparkSession)
    slim = docs.select(F.col(id_).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    long_ = F.length("text") > piece_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = batch.column("text")
            for a, b in _runs(texts):
                ids = c.encode(texts[a:b].to_pylist())
                columns = {n: batch.column(n).slice(a, b - a) for n in batch.schema.names if n != "text"}
                yield pa.RecordBatch.from_pydict(columns | {"ids": pa.array(ids, pa.binary())})

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("piece").sort_values("piece")
        ids = codec(path).join([np.frombuffer(x, dtype="<u4") for x in frame["ids"]]).tobytes()
        first = frame.iloc[0]
        return pd.DataFrame({"id": [first["id"]] * first["copies"], "ids": [ids] * first["copies"]})

    short = slim.where(~long_).mapInArrow(run, f"id {kind}, ids binary")
    # Equal rows are joined once and given back as often as they came.
    cut = slim.where(long_).groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies"))
    cut = cut.withColumn("key", F.xxhash64("id", "text")).withColumn("n", F.ceil(F.length("text") / piece_chars))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    start = F.col("piece") * piece_chars + 1
    cut = cut.withColumn("text", F.substring("text", start, F.lit(piece_chars))).repartition("key", "piece")
    encoded = cut.select("id", "key", "copies", "piece", "text").mapInArrow(
        run, f"id {kind}, key long, copies long, piece int, ids binary"
    )
    joined = encoded.groupBy("key").applyInPandas(whole, f"id {kind}, ids binary")
    out = short.unionByName(joined)
    return out.select(F.col("id").alias(id_), "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"))


def decode(encoded: DataFrame, path: str, id_: str = "doc_id") -> DataFrame:
    """The same rows with ``text``, what the ids stand for; bytes that aren't UTF-8 become U+FFFD."""
    ship_code(encoded.sparkSession)
    slim = encoded.select(F.col(id_).alias("id"), "ids", "n_tokens")
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = vocabulary(path)
        for batch in batches:
            ids = batch.column("ids")
            for a, b in _runs(ids):
                raw = (c.raw(np.frombuffer(x or b"", dtype="<u4")) for x in ids[a:b].to_pylist())
                texts = [x.decode("utf-8", "replace") for x in raw]
                columns = {n: batch.column(n).slice(a, b - a) for n in ("id", "ids", "n_tokens")}
                yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(texts, pa.string())})

    out = slim.mapInArrow(run, f"id {kind}, ids binary, n_tokens long, text string")
    return out.withColumnRenamed("id", id_)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    out = decode(encode(read_table(spark, sf_dir, "documents"), path), path)
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )
