"""Token files of directly addressable codes.

Every id is cut into chunks of 8 bits, lowest first.  Level k holds the k-th chunk of the ids that have one, and a
bitmap with a set bit where the id goes on at level k + 1; the number of set bits before a place (a rank, found with
a directory of counts each 512 bits) is the id's place there.  So any token, or any run of tokens, is read from a
block without decoding what stands before it.

A file is a Parquet table with one row per block: ``part`` and ``block`` in corpus order, ``start`` (tokens before the
block inside its part), ``n_tokens``, ``codes`` (the block), and ``docs`` (id, start and length of each document).
Documents stand in ascending id (nulls first, equal ids by text), each whole in one block and ended by ``end_id``.
Null and empty texts have the end id alone.  Blocks hold BLOCK_TOKENS tokens or one longer document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.bpe import _runs, codec, vocabulary_path
from leafmill.session import materialize, read_table, ship_code

BLOCK_TOKENS = 65_536
#: Text that one writing task takes, about.
PART_BYTES = 128_000_000
LEVELS = 4
RANK_BYTES = 64
END_ID = 2
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint32)


def pack(ids: np.ndarray) -> bytes:
    """One block of unsigned 32-bit ids."""
    rest = ids.astype(np.uint32)
    out = []
    for level in range(LEVELS):
        goes_on = rest > 0xFF
        bits = np.packbits(goes_on, bitorder="little")
        counts = np.add.reduceat(_ONES[bits], np.arange(0, len(bits), RANK_BYTES)) if len(bits) else _ONES[:0]
        directory = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4") if len(bits) else _ONES[:0]
        out.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), directory.tobytes()))
        rest = rest[goes_on] >> np.uint32(8)
    head = np.array([x[0] for x in out], dtype="<u4").tobytes()
    return head + b"".join(b"".join(x[1:]) for x in out)


class Block:
    """Reads tokens of a packed block by place."""

    def __init__(self, raw: bytes) -> None:
        sizes = np.frombuffer(raw, dtype="<u4", count=LEVELS).tolist()
        at, self.levels = 4 * LEVELS, []
        for n in sizes:
            n_bits = -(-n // 8)
            n_ranks = -(-n_bits // RANK_BYTES)
            chunks = np.frombuffer(raw, np.uint8, n, at)
            bits = np.frombuffer(raw, np.uint8, n_bits, at + n)
            ranks = np.frombuffer(raw, "<u4", n_ranks, at + n + n_bits)
            self.levels.append((chunks, bits, ranks))
            at += n + n_bits + 4 * n_ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, place: int) -> int:
        """Set bits of a level before a place."""
        _, bits, ranks = self.levels[level]
        whole = place // 8
        super_ = min(whole // RANK_BYTES, len(ranks) - 1)
        n = int(ranks[super_]) + int(_ONES[bits[super_ * RANK_BYTES : whole]].sum())
        return n + (int(_ONES[bits[whole] & ((1 << place % 8) - 1)]) if place % 8 else 0)

    def read(self, start: int, end: int) -> np.ndarray:
        """Tokens start .. end - 1; only their own chunks are touched."""
        out = np.zeros(end - start, dtype="<u4")
        places, a, b = np.arange(end - start), start, end
        for level, (chunks, bits, _) in enumerate(self.levels):
            if a >= b:
                break
            out[places] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            flags = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            places = places[flags]
            a = self._rank(level, a) if len(places) else 0
            b = a + len(places)
        return out

    def __getitem__(self, place: int) -> int:
        return int(self.read(place, place + 1)[0])


def write(docs: DataFrame, path: str, text: str = "text", id_: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Blocks of all documents, written into the shared folder and read back as a table."""
    ship_code(docs.sparkSession)
    slim = docs.select(F.col(id_).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        part = TaskContext.get().partitionId()
        block = before = 0
        ids, names, sizes = [], [], []

        def flush() -> pa.RecordBatch:
            starts = before + np.cumsum([0, *sizes[:-1]])
            told = [{"id": i, "start": int(s), "n": n} for i, s, n in zip(names, starts, sizes, strict=True)]
            row = {
                "part": [part], "block": [block], "start": [before], "n_tokens": [sum(sizes)],
                "codes": [pack(np.frombuffer(b"".join(ids), dtype="<u4"))], "docs": [told],
            }
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = None
        for batch in batches:
            told = pa.struct([("id", batch.schema.field("id").type), ("start", pa.int64()), ("n", pa.int64())])
            schema = pa.schema(
                [("part", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                 ("codes", pa.binary()), ("docs", pa.list_(told))]
            )
            texts, keys = batch.column("text"), batch.column("id")
            for a, b in _runs(texts):
                for key, raw in zip(keys[a:b].to_pylist(), c.encode(texts[a:b].to_pylist()), strict=True):
                    n = len(raw) // 4 + 1
                    if names and sum(sizes) + n > BLOCK_TOKENS:
                        yield flush()
                        before += sum(sizes)
                        block += 1
                        ids, names, sizes = [], [], []
                    ids += raw, end
                    names.append(key)
                    sizes.append(n)
        if names:
            yield flush()

    dealt = slim.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    blocks = dealt.mapInArrow(
        run,
        "part int, block long, start long, n_tokens long, codes binary, "
        f"docs array<struct<id: {kind}, start: long, n: long>>",
    )
    return materialize(blocks, "tokens")


def read(blocks: DataFrame, id_: str = "doc_id") -> DataFrame:
    """id, ``start`` (tokens of all documents before it), ``n_tokens`` and ``ids`` (binary) of every document."""
    ship_code(blocks.sparkSession)
    kind = blocks.schema["docs"].dataType.elementType["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, raw, docs in zip(
                *(batch.column(k) for k in ("part", "start", "codes", "docs")), strict=True
            ):
                block, first, told = Block(raw.as_py()), start.as_py(), docs.as_py()
                ids = [block.read(x["start"] - first, x["start"] - first + x["n"]).tobytes() for x in told]
                kinds = docs.type.value_type
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * len(told), pa.int32()),
                        pa.array([x["id"] for x in told], kinds.field("id").type),
                        pa.array([x["start"] for x in told], pa.int64()),
                        pa.array([x["n"] for x in told], pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    names=["part", "id", "local", "n_tokens", "ids"],
                )

    found = blocks.select("part", "start", "codes", "docs").mapInArrow(
        run, f"part int, id {kind}, local long, n_tokens long, ids binary"
    )
    # One row for each task that wrote, so this window and the broadcast stay small at any size.
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = found.join(F.broadcast(totals), "part")
    return out.select(F.col("id").alias(id_), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    blocks = write(read_table(spark, sf_dir, "documents"), vocabulary_path())
    return read(blocks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
