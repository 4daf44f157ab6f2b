"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are taken relative to the mean, rotated at random and kept as one bit per dimension, packed, with two correction
scalars: the length of the residual and the inner product of its direction with its code. From packed bits and scalars
follow an estimate of each inner product and a bound of its error; vectors whose least possible distance is above the
k-th smallest greatest possible one are out, all others are ranked by their exact distance.

The index holds every vector, in blocks; queries are a stated set, in blocks too, and each pair of blocks gives at most
k rows a query. Defined results: vectors that are null, zero or hold null or non-finite components take no part;
vectors of different length have no distance; rows that repeat an id are candidates on their own, but never of their own
id; a query row that repeats an id with the same vector is asked once, and one with another vector is a query of its own,
with its own ranks; ties go to the smaller id; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors of one block of the index, and queries of one block.
BLOCK, QUERY_BLOCK = 4096, 512
#: Bytes of queries that are broadcast at once; more go in several scans of the index.
PART_BYTES = 64 << 20
#: Standard deviations of the estimate that the bound allows for; a normal error is beyond it once in 10**4 cases.
BOUND = 3.9
SEED = 20_24
_BLOCK = "dim int, n int, ids binary, vectors binary, codes binary, lengths binary, inner binary"
#: Originals are kept in single precision, as they come, or in double where that would change one.
_WIDTHS = {4: np.float32, 8: np.float64}


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    return np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))[0]


def _usable(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector the places of the rows that take part and their vectors as a matrix."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    values = lists.flatten()
    ends = np.cumsum(sizes)
    x = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
    good = np.concatenate([[0], np.cumsum(np.isfinite(x))])
    filled = np.concatenate([[0], np.cumsum(x != 0)])
    ok = (sizes > 0) & (good[ends] - good[ends - sizes] == sizes) & (filled[ends] > filled[ends - sizes])
    out = []
    for dim in np.unique(sizes[ok]):
        rows = np.flatnonzero(ok & (sizes == dim))
        out.append((rows, x[(ends[rows] - dim)[:, None] + np.arange(dim)]))
    return out


def encode(vectors: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, residual lengths and inner products of each direction with its own code."""
    residual = (vectors - center) @ rotation(vectors.shape[1])
    length = np.linalg.norm(residual, axis=1)
    direction = residual / np.where(length > 0, length, 1)[:, None]
    inner = np.abs(direction).sum(1) / np.sqrt(vectors.shape[1])
    return np.packbits(direction > 0, axis=1), length, np.where(length > 0, inner, 1.0)


def bounds(codes, length, inner, queries: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest plausible squared distance of each query (row) to each coded vector (column)."""
    dim = queries.shape[1]
    residual = (queries - center) @ rotation(dim)
    far = np.linalg.norm(residual, axis=1)
    direction = residual / np.where(far > 0, far, 1)[:, None]
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    estimate = direction.astype(np.float32) @ signs.T / inner[None, :]
    error = BOUND * np.sqrt(np.maximum(1 - inner**2, 0)) / inner / np.sqrt(max(dim - 1, 1)) + 1e-5
    both = length[None, :] ** 2 + far[:, None] ** 2
    scale = 2 * length[None, :] * far[:, None]
    return both - scale * np.minimum(estimate + error, 1), both - scale * np.maximum(estimate - error, -1)


def _center(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector for each dimension, summed up in each task first: one row for each task and length of vector."""

    def run(batches):
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for rows, x in _usable(batch.column("embedding")):
                n, s = sums.get(x.shape[1], (0, 0.0))
                sums[x.shape[1]] = (n + len(rows), s + x.sum(0))
        for dim, (n, s) in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([n], pa.int64()), "s": pa.array([s.tolist()], pa.list_(pa.float64()))})

    found = vectors.select("embedding").mapInArrow(run, "dim int, n long, s array<double>")
    means = found.select("dim", "n", F.posexplode("s")).groupBy("dim", "pos").agg((F.sum("col") / F.sum("n")).alias("m")).collect()
    out: dict[int, np.ndarray] = {}
    for r in means:
        out.setdefault(r["dim"], np.zeros(r["dim"]))[r["pos"]] = r["m"]
    return out


def build_blocks(vectors: DataFrame, centers: dict[int, np.ndarray], size: int) -> DataFrame:
    """The vectors of each partition in blocks of at most ``size``: packed codes, scalars, ids and originals."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def block(ids, x):
            dim = x.shape[1]
            codes, length, inner = encode(x, centers.get(dim, np.zeros(dim)))
            own = x.astype(np.float32)
            own = own if (own == x).all() else x
            values = [dim, len(ids), ids.tobytes(), own.tobytes(), codes.tobytes(), length.tobytes(), inner.tobytes()]
            names = [f.split()[0] for f in _BLOCK.split(", ")]
            kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

        for batch in batches:
            known = np.asarray(batch.column("vec_id").is_valid())
            every = np.asarray(pc.fill_null(batch.column("vec_id"), 0), dtype=np.int64)
            for rows, x in _usable(batch.column("embedding")):
                ids, x = every[rows][known[rows]], x[known[rows]]
                before = held.pop(x.shape[1], None)
                if before is not None:
                    ids, x = np.concatenate([before[0], ids]), np.concatenate([before[1], x])
                while len(ids) >= size:
                    yield block(ids[:size], x[:size])
                    ids, x = ids[size:], x[size:]
                held[x.shape[1]] = ids, x
        for ids, x in held.values():
            if len(ids):
                yield block(ids, x)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, _BLOCK)


def _originals(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, _WIDTHS[len(raw) // (n * dim)]).reshape(n, dim)


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed in the order of the dimensions."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += (x[:, j].astype(np.float64) - q[j]) ** 2
    return np.sqrt(total)


def search_block(ids, x, codes, length, inner, query_ids, queries, center, k: int):
    """At most ``k`` nearest of one block for each query, all ties in: (query, its place, vector, distance)."""
    queries = queries.astype(np.float64)
    low, high = bounds(codes, length, inner, queries, center)
    for q in range(len(queries)):
        other = np.flatnonzero(ids != query_ids[q])
        if not len(other):
            continue
        lows, highs = low[q, other], high[q, other]
        limit = np.partition(highs, k - 1)[k - 1] if len(other) > k else np.inf
        chosen = other[lows <= limit]
        distance = _exact(x[chosen], queries[q])
        best = np.lexsort((ids[chosen], distance))[:k]
        yield np.full(len(best), query_ids[q]), np.full(len(best), q), ids[chosen[best]], distance[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest of ``vectors`` to each query."""
    centers = _center(vectors)
    index = materialize(build_blocks(vectors, centers, BLOCK), "ann-index")
    asked = queries.select("vec_id", "embedding").distinct()
    blocks = build_blocks(asked.repartition(-(-queries.count() // QUERY_BLOCK) or 1), centers, QUERY_BLOCK)
    asked = materialize(blocks.select(F.monotonically_increasing_id().alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in ("dim", "n", "ids", "vectors"))), "ann-queries")
    parts = -(-(asked.agg(F.sum(F.length("q_ids") + F.length("q_vectors")).alias("b")).first()["b"] or 0) // PART_BYTES) or 1

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim, n, m = r["dim"], r["n"], r["q_n"]
                if dim != r["q_dim"]:
                    continue
                found = list(
                    search_block(
                        np.frombuffer(r["ids"], np.int64),
                        _originals(r["vectors"], n, dim),
                        np.frombuffer(r["codes"], np.uint8).reshape(n, -1),
                        np.frombuffer(r["lengths"]),
                        np.frombuffer(r["inner"]),
                        np.frombuffer(r["q_ids"], np.int64),
                        _originals(r["q_vectors"], m, dim),
                        centers[dim],
                        k,
                    )
                )
                if found:
                    columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
                    names = ["query_id", "place", "vec_id", "score"]
                    yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]] * len(columns[0]), pa.int64()), *columns], names=["q_block", *names])

    def against(part: int) -> DataFrame:
        own = asked.where(F.pmod(F.xxhash64("q_block"), F.lit(parts)) == part)
        return index.crossJoin(F.broadcast(own)).mapInArrow(run, "q_block long, query_id long, place long, vec_id long, score double")

    # the stated query set against the whole index, block by block: a row for each pair of blocks, queries in parts that may be broadcast
    found = functools.reduce(DataFrame.unionByName, map(against, range(parts)))
    order = Window.partitionBy("q_block", "place").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search_hundredths(vectors: DataFrame, k: int = 10) -> DataFrame:
    """The contract's set: every row whose vec_id is divisible by 100 against all rows."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k)
