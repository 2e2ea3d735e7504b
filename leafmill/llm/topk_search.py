"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks.  Each block sorts its vectors once along every dimension.  A query walks the lists of a
block, each from its favourable end (the large values where its own component is positive, the small ones where it is
negative); a vector met for the first time is scored at random access.  After each step the *bound* is the best score of
a vector that stands at or behind the current place of every list and isn't longer than the block's longest.  No vector
that hasn't been met can beat it, so the walk ends once the bound is below the k-th score that the query has.  Equal
scores rank by smaller id, so it goes on while they are equal.  Each query walks alone; a step goes on in those lists, and
to that depth (a power of two), that lower the bound most for each vector that they show.

The k-th score starts high: a first pass takes one block of candidates, hands it to all queries, and the k-th score found
there is every query's *floor* in all blocks.  It is the score of a row of the table, so nothing above or equal to it is
left out.

Components are ``floor(256 * x)`` with x as double.  Vectors that are null or hold a null or non-finite component take
no part.  A shorter vector counts as filled up with zeros.  Rows with a null id take no part.  Rows that share an id
are one vector: the smallest in array order.  A query without candidates has no rows.  Scores are exact while they fit a
long.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import in_job, materialize, read_table, ship_code

#: Candidates of a block and queries of a set: each candidate is sent to every set and each query to every block.
BLOCK_ROWS, QUERY_ROWS = 16_384, 4_096
#: Bytes of vectors, of 8 for each component, that are told to every task for a first floor.
FLOOR_BYTES = 32_000_000
#: By how much a list's next depth exceeds the one before, and the share of a block after which a walk scores the rest.
STRIDE, ENOUGH = 1.2, 0.6


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of every component, or null where the vector takes no part."""
    far = F.lit(float("inf"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == far))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return F.when(~odd, scaled)


class Block:
    """Vectors with one sorted list for each dimension, and its values at growing depths from either end."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        n = len(ids)
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        at = np.take_along_axis(vectors, self.order.T, axis=0).T.astype(np.float64)
        self.depths = np.unique(np.append(np.ceil(STRIDE ** np.arange(np.log(max(n, 2)) / np.log(STRIDE))).clip(1, n), n)).astype(np.int64)
        self.high, self.low = at[:, n - self.depths], -at[:, self.depths - 1]
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
        self.scored = 0

    def search(self, own: int, query: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) of other ids, best first; those below ``floor`` may be missing."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        if not len(dims):  # every score is 0
            return self._best([(np.zeros(n, dtype=np.int64), np.arange(n))], own, k)
        # Each list from its favourable end, and as if the query's own component were positive.
        positive, size = query[dims] > 0, np.abs(query[dims]).astype(np.float64)
        values = np.where(positive[:, None], self.high[dims], self.low[dims])
        walked = np.full(len(dims), -1)
        met = np.zeros(n, dtype=bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        kth = floor
        while True:
            reached = values[np.arange(len(dims)), np.maximum(walked, 0)]
            bound, pull = self._bound(size, reached)
            slack = 1e-9 * self.norm * np.sqrt((size**2).sum())
            if kth is not None and bound < kth - slack or (walked == len(self.depths) - 1).any():
                return self._best(found, own, k)
            new = np.zeros(n, dtype=bool)
            need = np.inf if kth is None else bound - kth + 2 * slack
            for j, to in self._next(size, values, reached, walked, pull, need, int(met.sum())):
                a, b = int(self.depths[walked[j]]) if walked[j] >= 0 else 0, int(self.depths[to])
                new[self.order[dims[j], n - b : n - a] if positive[j] else self.order[dims[j], a:b]] = True
                walked[j] = to
            if met.sum() > ENOUGH * n:  # to walk on costs more than to score the rest
                new[:], walked[:] = True, len(self.depths) - 1
            rows = np.flatnonzero(new & ~met)
            met |= new
            if len(rows):
                self.scored += len(rows)
                scores = self.vectors[rows] @ query
                keep = scores >= kth if kth is not None else np.ones(len(rows), dtype=bool)
                if keep.any():
                    found.append((scores[keep], rows[keep]))
                    best = self._best(found, own, k)
                    if len(best) == k:
                        kth = best[-1][0] if kth is None else max(kth, best[-1][0])

    def _bound(self, size: np.ndarray, reached: np.ndarray) -> tuple[float, float]:
        """The most that a vector of the block's norm can score with no component above ``reached``, and its pull.

        That vector is min(reached, pull * size) for the pull that gives it the norm.  For any other pull the Lagrange
        dual, which is returned, is a bound too, so the search for it needn't be exact.
        """
        low, high = 0.0, float(np.max(reached / size))
        if high <= 0 or (reached**2).sum() <= self.norm**2:
            return float((size * reached).sum()), np.inf
        for _ in range(12):
            pull = (low + high) / 2
            if (np.minimum(reached, pull * size) ** 2).sum() > self.norm**2:
                high = pull
            else:
                low = pull
        best = np.minimum(reached, high * size)
        return float((size * best).sum() - ((best**2).sum() - self.norm**2) / (2 * high)), high

    def _next(self, size, values, reached, walked, pull, need: float, met: int) -> list[tuple[int, int]]:
        """The list to go on in and how deep: where the bound falls most, up to ``need``, for each vector shown.

        A step shows at most as many vectors as have been met, and at least half of that, so steps stay few.
        """

        def share(x: np.ndarray, a: np.ndarray) -> np.ndarray:
            best = np.minimum(x, pull * a)
            return a * best - best**2 / (2 * pull)

        further = np.arange(len(self.depths)) > walked[:, None]
        shown = self.depths - np.where(walked >= 0, self.depths[np.maximum(walked, 0)], 0)[:, None]
        gain = np.minimum(share(reached, size)[:, None] - share(values, size[:, None]), need)
        fits = further & (shown <= max(16, met)) & (2 * shown >= met)
        gain = np.where(fits, gain / np.maximum(shown, 1), -1.0)
        to = gain.argmax(axis=1)
        most = gain[np.arange(len(to)), to]
        if most.max() <= 0:  # no list says anything yet: a step in each
            return [(j, int(w) + 1) for j, w in enumerate(walked)]
        best = int(most.argmax())
        return [(best, int(to[best]))]

    def _best(self, found: list[tuple[np.ndarray, np.ndarray]], own: int, k: int) -> list[tuple[int, int]]:
        if not found:
            return []
        scores, rows = (np.concatenate(x) for x in zip(*found, strict=True))
        ids = self.ids[rows]
        other = ids != own
        scores, ids = scores[other], ids[other]
        if len(scores) > 4 * k:  # ties of the k-th score must stay
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[near], ids[near]
        first = np.lexsort((ids, -scores))[:k]
        return list(zip(scores[first].tolist(), ids[first].tolist(), strict=True))


def _matrix(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    """Rows filled up with zeros; as doubles where every product sum is exact in them, which multiply faster."""
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    most = int(np.abs(out).max(initial=0))
    return out.astype(np.float64) if most * most * max(dims, 1) < 2**53 else out


def _search_all(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """Rows of one block and one set of queries: (query_id, id, score) of the best of each query, and the vectors scored."""
    table = _matrix(list(frame["v"]), max(map(len, frame["v"])))
    ids, query = frame["id"].to_numpy(), frame["query"].to_numpy()
    rows: list[tuple[int, int, int]] = []
    if query.any() and not query.all():
        block = Block(ids[~query], table[~query])
        floors = [None if pd.isna(x) else int(x) for x in frame["floor"][query]]
        for own, vector, floor in zip(ids[query].tolist(), table[query], floors, strict=True):
            rows.extend((own, i, int(score)) for score, i in block.search(own, vector, k, floor))
    return pd.DataFrame(rows, columns=["query_id", "id", "score"]).astype("int64")


def search(
    vectors: DataFrame, is_query: Column, k: int, id_: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), the id column and score of the k best other rows of every query row."""
    ship_code(vectors.sparkSession)
    slim = vectors.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), is_query.alias("q"), whole_numbers(F.col(vector)).alias("v"))
    slim = slim.where("v is not null").groupBy("id").agg(F.max("q").alias("q"), F.min("v").alias("v"))
    found = in_job("nearest", lambda: _nearest(slim, k))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_), "score")


def _nearest(slim: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the best of each block for each query."""
    slim = materialize(slim, "whole")
    counts = slim.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q"), F.max(F.size("v")).alias("dims")).first()
    n_blocks, n_sets = (max(1, -(-x // size)) for x, size in ((counts["n"], BLOCK_ROWS), (counts["q"], QUERY_ROWS)))
    mine = lambda own: F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
    every = lambda other: F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    queries = slim.where("q").withColumn("floor", F.lit(None).cast("long"))
    if n_blocks > 1:
        queries = slim.where("q").join(_floors(slim, mine(n_blocks) == 0, counts["dims"], n_sets, k), "id", "left")
    schema = "query_id long, id long, score long"
    ask = queries.select(every(n_blocks).alias("block"), mine(n_sets).alias("set"), F.lit(True).alias("query"), "id", "v", "floor")
    told = slim.select(mine(n_blocks).alias("block"), every(n_sets).alias("set"), F.lit(False).alias("query"), "id", "v", F.lit(None).cast("long").alias("floor"))
    return told.unionByName(ask).groupBy("block", "set").applyInPandas(lambda frame: _search_all(frame, k), schema)


def _rows(lists: pa.ListArray) -> list[np.ndarray]:
    """The vectors of an Arrow column as numpy views."""
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [values[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _floors(slim: DataFrame, in_first: Column, dims: int, n_sets: int, k: int) -> DataFrame:
    """(id, floor) of the queries that find k others in the first block: the k-th score there.

    Of the block as many rows are told to every task as FLOOR_BYTES hold, however wide they are; any rows give a floor.
    """
    rows = max(k + 1, min(2 * BLOCK_ROWS, FLOOR_BYTES // (8 * max(dims, 1))))
    first = slim.where(in_first).orderBy("id").limit(rows).select("id", "v").toArrow().combine_chunks()
    lists = first["v"].combine_chunks() if len(first) else pa.array([], pa.list_(pa.int64()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    shared = slim.sparkSession.sparkContext.broadcast((first["id"].to_numpy(), lists.offsets.to_numpy(), lists.values.to_numpy()))
    held: dict[int, Block] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends, values = shared.value
        vectors = [values[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        for batch in batches:
            own = batch.column("id").to_numpy()
            asked = _rows(batch.column("v"))
            width = max(map(len, [*vectors, *asked]), default=0)
            if width not in held:
                held[width] = Block(ids, _matrix(vectors, width))
            block, out = held[width], []
            for i, vector in zip(own.tolist(), _matrix(asked, width), strict=True):
                # As doubles only where every product sum with the block is exact in them.
                most = np.abs(vector).max(initial=0) * np.abs(block.vectors).max(initial=0) * max(width, 1)
                exact = block.vectors.dtype == np.int64 or most < 2**53
                best = block.search(i, vector.astype(block.vectors.dtype), k) if exact else []
                out.append(int(best[-1][0]) if len(best) == k else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.int64())], names=["id", "floor"])

    return slim.where("q").select("id", "v").repartition(max(n_sets, slim.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "id long, floor long")


def op1_topk_search(spark, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
