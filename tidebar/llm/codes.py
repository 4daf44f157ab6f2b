"""Vector code compression: product quantisation in whole numbers, entries filtered by lower bounds from segment means.

Each component becomes floor(1024 * x); a vector is cut into four consecutive parts and each part is replaced by the index of
the nearest entry of the codebook of its position. Codebooks start from the vectors of the smallest ids and are refined by
rounds of assignment and rounded means.

An entry is looked at from coarse to fine: one segment of the part, then two, four and eight. Over a segment of m components, the squared
distance is at least m times the squared difference of the means plus the squared difference of the lengths of what is left
after the mean. Entries whose bound is above the distance of an entry already measured (the one of the least bound at
each level) are out; what survives all levels, or the first that leaves few, is measured in whole numbers.

In Spark: a round is one scan in which every task adds up its parts by entry, at most one row for each entry and task, and one
shuffle of those sums. Codebooks are bounded by their own size (entries times components) whatever the table holds; they are
all that the driver sees.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; nor do vectors whose squared
distances could leave 64 bits (a whole number beyond 2**30 / sqrt(dimension)), and those that have another length than the
kept row with the smallest id, or one that has no four equal parts. Rows without an id are coded as others are and come last
among the ids; rows that repeat an id count once each, and start codebooks in order of their numbers; fewer rows than entries
give smaller codebooks; an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join
from .integers import integer_vectors

#: Fixed values of the contract: scale, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: No whole number is beyond this part of the root of the dimension, so that all squared distances fit in 64 bits.
ROOM = 2.0**30
#: Segments of a part, level by level; at so few entries a part, on average, they are measured at once.
SEGMENTS, FEW = (1, 2, 4, 8), 4
#: Vectors whose bounds are held at once.
BLOCK = 1024


def _edges(width: int, segments: int) -> np.ndarray:
    return np.unique(np.linspace(0, width, min(segments, width) + 1).astype(int))


def outlines(parts: np.ndarray, segments: int) -> np.ndarray:
    """Per row the scaled mean and the residual length of each segment: distances of outlines are lower bounds."""
    edges = _edges(parts.shape[1], segments)
    out = np.empty((len(parts), 2 * (len(edges) - 1)))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        own = parts[:, a:b].astype(np.float64)
        mean = own.mean(1)
        out[:, 2 * k] = mean * np.sqrt(b - a)
        out[:, 2 * k + 1] = np.linalg.norm(own - mean[:, None], axis=1)
    return out


def _measured(parts: np.ndarray, entries: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    away = parts[rows] - entries[cols]
    return np.einsum("ij,ij->i", away, away)


def assign(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (ties to the lower one) and its squared distance, in whole numbers."""
    code, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    levels = sorted({min(s, parts.shape[1]) for s in SEGMENTS})
    drawn = [outlines(entries, s) for s in levels]
    norms = [(d * d).sum(1) for d in drawn]
    for at in range(0, len(parts), BLOCK):
        own = parts[at : at + BLOCK]
        every = np.arange(len(own))
        open_ = np.ones((len(own), len(entries)), bool)
        best = np.full(len(own), np.iinfo(np.int64).max)
        for k, segments in enumerate(levels):
            mine = outlines(own, segments)
            norm = (mine * mine).sum(1)
            low = mine @ drawn[k].T
            low *= -2
            low += norm[:, None]
            low += norms[k]
            best = np.minimum(best, _measured(own, entries, every, low.argmin(1)))
            # outlines are rounded numbers: no entry goes for less than their error
            open_ &= low <= (best + 1e-11 * (norm + norms[k].max()) + 1e-9)[:, None]
            if np.count_nonzero(open_) <= FEW * len(own):
                break
        rows, cols = np.nonzero(open_)
        exact = _measured(own, entries, rows, cols)
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == np.repeat(least, np.diff(np.append(first, len(rows)))))
        hit = hit[np.unique(rows[hit], return_index=True)[1]]
        code[at : at + len(own)], error[at : at + len(own)] = cols[hit], least
    return code, error


def _kept(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    for d, rows, x in integer_vectors(batch.column("embedding"), SCALE, ROOM):
        if d == dim:
            return rows, x
    return np.zeros(0, np.int64), np.zeros((0, dim), np.int64)


def first_entries(vectors: DataFrame, entries: int = ENTRIES) -> list[np.ndarray]:
    """Codebooks of the kept rows with the smallest ids; no codebook if no row is kept."""

    def run(batches):
        for batch in batches:
            for _, rows, x in integer_vectors(batch.column("embedding"), SCALE, ROOM):
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(list(x), pa.list_(pa.int64()))], names=["vec_id", "x"])

    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, x array<long>")
    smallest = kept.orderBy(*order).limit(1).collect()
    if not smallest or len(smallest[0]["x"]) % PARTS:
        return []
    dim = len(smallest[0]["x"])
    first = kept.where(F.size("x") == dim).orderBy(*order).limit(entries).collect()
    return np.split(np.array([r["x"] for r in first], np.int64), PARTS, axis=1)


def refined(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: floored means of the parts assigned to each entry; unused entries stay."""
    size, width = books[0].shape

    def run(batches):
        count = np.zeros((PARTS, size), np.int64)
        sums = np.zeros((PARTS, size, width), np.int64)
        for batch in batches:
            _, x = _kept(batch, PARTS * width)
            for p, part in enumerate(np.split(x, PARTS, axis=1)):
                code, _ = assign(part, books[p])
                count[p] += np.bincount(code, minlength=size)
                np.add.at(sums[p], code, part)
        part, entry = np.nonzero(count)
        if len(part):
            found = [pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(found, names=["part", "entry", "n", "sums"])

    found = vectors.select("embedding").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    after = [b.copy() for b in books]
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # at most PARTS * ENTRIES rows
        after[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return after


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], label: str | None = None) -> DataFrame:
    """vec_id, the label column (if one is named), code and error of every kept row."""
    kind = vectors.schema["vec_id" if label is None else label].dataType.simpleString()
    dim = PARTS * books[0].shape[1] if books else 0

    def run(batches):
        for batch in batches:
            rows, x = _kept(batch, dim)
            if not len(rows):
                continue
            codes, error = np.zeros((len(rows), PARTS), np.uint8), np.zeros(len(rows), np.int64)
            for p, part in enumerate(np.split(x, PARTS, axis=1)):
                code, off = assign(part, books[p])
                codes[:, p], error = code, error + off
            own = batch.select(["vec_id", "label"]).take(pa.array(rows))
            found = [*own.columns, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)]
            yield pa.RecordBatch.from_arrays(found, names=["vec_id", "label", "code", "error"])

    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label or "vec_id").alias("label"), "embedding")
    return own.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(vectors: DataFrame, label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of ``vectors``."""
    books = first_entries(vectors)
    for _ in range(ROUNDS if books else 0):
        books = refined(vectors, books)
    # a key that no label text equals stands for null
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    coded = materialize(encode(vectors, books, label).select("vec_id", key.alias("label_key"), "code", "error"), "vector-codes")
    sums = coded.groupBy("label_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n"))
    joined = spread_join(coded, sums, ["label_key"], "n", coded.count(), F.struct("vec_id", "code"))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
