"""Exact top-k search by inner product, block at a time.

Each component becomes floor(256 * x). The index is a table of shelves: vectors in order of their ids, cut into blocks, each
with a forward index (its vectors) and the largest and smallest value of every component in it. For one query the sum over
components of its value times the block's largest (or, for negative values, smallest) one bounds every score in the block. A
query goes through the blocks of a shelf from the largest bound down and leaves when the next bound is below the k-th best
score it knows.

In Spark: queries are a stated set, held in blocks too, and go to the shelves in parts of checked size (``PART_BYTES``), each part
one broadcast and one scan of the index. What a task knows of a query (its k best) goes from shelf to shelf and is sent on
once, at the end of the task. Before that, every query is run against a sample of the index (one id in ``SAMPLE``); its k-th
score there bounds what it needs from then on, so that tasks send only what can still count, however many tasks there are.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; nor do those whose scores
could leave 64 bits (a whole number beyond 2**31 / sqrt(dimension)); vectors of different length have no score; rows without
an id take no part; rows that repeat an id are candidates on their own, but never of their own id; a query row that repeats
an id with the same vector is asked once, and one with another vector is a query of its own, with its own ranks; ties go to
the smaller id; fewer than k candidates give fewer rows; an empty table gives none. Other columns take no part.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .integers import integer_vectors

#: Fixed values of the contract.
SCALE, NEAREST = 256, 5
#: No whole number is beyond this part of the root of the dimension, so that all scores fit in 64 bits.
ROOM = 2.0**31
#: Vectors of a block and of a shelf; queries of a block.
BLOCK, SHELF, QUERY_BLOCK = 64, 4096, 512
#: Bytes of queries that are broadcast at once.
PART_BYTES = 64 << 20
#: One id in so many is in the sample.
SAMPLE = 64
_LEAST = np.iinfo(np.int64).min
_SHELF = "dim int, n int, ids binary, vectors binary, highs binary, lows binary"


def shelves(vectors: DataFrame, size: int) -> DataFrame:
    """The vectors of each partition in shelves of at most ``size``, each in order of ids, with its blocks' extremes."""

    def shelf(ids, x):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order].astype(np.int32)
        starts = np.arange(0, len(ids), BLOCK)
        parts = [ids, x, np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)]
        values = [pa.array([v], pa.int32()) for v in (x.shape[1], len(ids))] + [pa.array([p.tobytes()], pa.binary()) for p in parts]
        return pa.RecordBatch.from_arrays(values, names=[f.split()[0] for f in _SHELF.split(", ")])

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            every = np.asarray(batch.column("vec_id"))
            for dim, rows, x in integer_vectors(batch.column("embedding"), SCALE, ROOM):
                ids = every[rows]
                if dim in held:
                    ids, x = np.concatenate([held[dim][0], ids]), np.concatenate([held[dim][1], x])
                while len(ids) >= size:
                    yield shelf(ids[:size], x[:size])
                    ids, x = ids[size:], x[size:]
                held[dim] = ids, x
        for ids, x in held.values():
            if len(ids):
                yield shelf(ids, x)

    known = vectors.where(F.col("vec_id").isNotNull())
    return known.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, _SHELF)


class Best:
    """The k best of each query of a block: scores (largest first) and ids, ``_LEAST`` where there is none."""

    def __init__(self, queries: int, k: int, floors: np.ndarray):
        self.scores, self.ids = np.full((queries, k), _LEAST), np.zeros((queries, k), np.int64)
        self.floors = floors

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floors)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (a row for each of ``rows``, a column for each of ``ids``) that may belong to the best."""
        hopeful = scores.max(1) >= np.maximum(self.kth()[rows], _LEAST + 1)
        rows, scores = rows[hopeful], scores[hopeful]
        if not len(rows):
            return
        s = np.concatenate([self.scores[rows], scores], axis=1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        k = self.scores.shape[1]
        order = np.lexsort((i, -np.maximum(s, _LEAST + 1)), axis=1)[:, :k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search_shelf(ids, x, highs, lows, query_ids, queries, best: Best) -> int:
    """Add what one shelf has to ``best``; the number of (query, block) pairs that were scored."""
    most = max(int(np.abs(x).max(initial=0)), 1) * max(int(np.abs(queries).max(initial=0)), 1) * x.shape[1]
    kind = np.float64 if most < 2**53 else np.int64  # products of doubles are exact up to there
    x, q = x.astype(kind), queries.astype(kind)
    bounds = (np.maximum(q, 0) @ highs.astype(kind).T + np.minimum(q, 0) @ lows.astype(kind).T).astype(np.int64)
    order = np.argsort(-bounds, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
    begin, wave, scored = 0, 1, 0
    while begin < bounds.shape[1]:
        end = min(begin + wave, bounds.shape[1])
        kth = best.kth()
        # blocks by falling bounds: a query whose next block cannot reach its k-th score has ended (equal scores may win by id)
        going = np.take_along_axis(bounds, order[:, begin : begin + 1], 1)[:, 0] >= kth
        if not going.any():
            break
        turn = going[:, None] & (rank >= begin) & (rank < end) & (bounds >= kth[:, None])
        for b in np.flatnonzero(turn.any(0)):
            rows = np.flatnonzero(turn[:, b])
            own = ids[b * BLOCK : (b + 1) * BLOCK]
            scores = (q[rows] @ x[b * BLOCK : (b + 1) * BLOCK].T).astype(np.int64)
            scores[own[None, :] == query_ids[rows][:, None]] = _LEAST
            best.add(rows, scores, own)
            scored += len(rows)
        begin, wave = end, 2 * wave
    return scored


def _numbers(column: pa.Array, row: int, kind) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), kind)


def _searched(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query in each task, as far as they reach the query's floor: (q_block, place, query_id, vec_id, score)."""

    def run(batches):
        known: dict[int, tuple[np.ndarray, Best]] = {}
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for r in range(batch.num_rows):
                dim = col["dim"][r].as_py()
                if dim != col["q_dim"][r].as_py():
                    continue
                block, query_ids = col["q_block"][r].as_py(), _numbers(col["q_ids"], r, np.int64)
                if block not in known:
                    floors = np.full(len(query_ids), _LEAST)
                    for f in col["floors"][r].as_py() or ():
                        floors[f["place"]] = f["kth"]
                    known[block] = query_ids.copy(), Best(len(query_ids), k, floors)
                search_shelf(
                    _numbers(col["ids"], r, np.int64),
                    *(_numbers(col[c], r, np.int32).reshape(-1, dim) for c in ("vectors", "highs", "lows")),
                    query_ids,
                    _numbers(col["q_vectors"], r, np.int32).reshape(-1, dim),
                    known[block][1],
                )
        for block, (query_ids, best) in known.items():
            rows, cols = np.nonzero((best.scores > _LEAST) & (best.scores >= best.floors[:, None]))
            found = [np.full(len(rows), block), rows, query_ids[rows], best.ids[rows, cols], best.scores[rows, cols]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["q_block", "place", "query_id", "vec_id", "score"])

    return index.crossJoin(F.broadcast(asked)).mapInArrow(run, "q_block long, place long, query_id long, vec_id long, score long")


def _in_parts(index: DataFrame, asked: DataFrame, size: int, k: int) -> DataFrame:
    """All queries (``size`` bytes of them) against all shelves, in parts small enough to be broadcast."""
    parts = -(-size // PART_BYTES) or 1
    own = [asked.where(F.pmod(F.xxhash64("q_block"), F.lit(parts)) == p) for p in range(parts)]
    return functools.reduce(DataFrame.unionByName, [_searched(index, part, k) for part in own])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def largest_products(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` vectors with the largest inner products with each query."""
    index = materialize(shelves(vectors, SHELF), "topk-index")
    sample = materialize(shelves(vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(SAMPLE)) == 0), SHELF), "topk-sample")
    asked = queries.select("vec_id", "embedding").distinct().repartition(-(-queries.count() // QUERY_BLOCK) or 1)
    asked = materialize(shelves(asked, QUERY_BLOCK).select(F.monotonically_increasing_id().alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in ("dim", "ids", "vectors"))), "topk-queries")
    size = asked.agg(F.sum(F.length("q_ids") + F.length("q_vectors")).alias("b")).first()["b"] or 0
    nothing = F.lit(None).cast("array<struct<place:long,kth:long>>").alias("floors")
    seeds = _ranked(_in_parts(sample, asked.select("*", nothing), size, k), k).where(F.col("rank") == k)
    floors = seeds.groupBy("q_block").agg(F.collect_list(F.struct("place", F.col("score").alias("kth"))).alias("floors"))  # at most QUERY_BLOCK of them
    ready = materialize(asked.join(floors, "q_block", "left"), "topk-floors")
    return _ranked(_in_parts(index, ready, size, k), k).select("query_id", "rank", "vec_id", "score")


def search_fiftieths(vectors: DataFrame, k: int = NEAREST) -> DataFrame:
    """The contract's set: every row whose vec_id is divisible by 50 against all rows."""
    return largest_products(vectors, vectors.where(F.col("vec_id") % 50 == 0), k)
