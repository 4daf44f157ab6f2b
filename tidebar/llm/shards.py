"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) go, largest first, into the bin with the tightest remaining capacity that still takes them, found in
a balanced tree of remaining capacities; the fixed capacity is the least for which the wanted number of bins suffices.
Only sizes take part in the packing, so the driver sees a histogram: groups of a five-hundredth of a shard and more on their
own (a few thousand at most, as their sizes add up to all shards), smaller ones counted by size class. Which groups of a
class go where is decided by their rank in it, found in two levels (buckets, then rows of a bucket), never in one task.

Defined results: a null text has size 1 and CRC 0, and all null texts are one group; documents that repeat keep a row
each; an empty table gives no rows; a group larger than a fair share has a bin of its own.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import group_key, materialize, spread_join

#: Size classes of small groups: each is at most so much wider than its least size.
CLASS_STEP = 1.001
#: Groups of at least this part of a fair share are packed one by one.
SINGLE_PART = 1 / 500
#: Rows ranked together in one window partition, about.
RANK_ROWS = 20_000


class Bins:
    """Remaining capacities (room, bin) in a treap: a search tree by room that random priorities keep balanced."""

    def __init__(self, capacities: list[float]):
        self.draw, self.root = random.Random(0).random, None
        for b, room in enumerate(capacities):
            self._add((room, b))

    def _add(self, key: tuple[float, int]) -> None:
        low, high = self._cut(self.root, key)
        self.root = self._join(self._join(low, [self.draw(), key, None, None]), high)

    def _cut(self, node, key):
        """The nodes before ``key`` and the others."""
        if node is None:
            return None, None
        if node[1] < key:
            node[3], high = self._cut(node[3], key)
            return node, high
        low, node[2] = self._cut(node[2], key)
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[0] > high[0]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def _take_first(self, node):
        """The least key of a tree, and the tree without it."""
        if node[2] is None:
            return node[1], node[3]
        key, node[2] = self._take_first(node[2])
        return key, node

    def place(self, size: float, n: int) -> tuple[int, int] | None:
        """Put as many of ``n`` equal items as fit into the tightest bin; (bin, how many), or None where none fits."""
        low, high = self._cut(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        (room, b), high = self._take_first(high)
        self.root = self._join(low, high)
        k = min(n, int(room // size))
        self._add((room - k * size, b))
        return b, k


def fit(runs: list[tuple[float, int]], capacities: list[float]) -> list[list[tuple[int, int]]] | None:
    """Best fit of runs (size, count), largest first: for each run its (bin, count) parts; None if something is left."""
    bins, placed = Bins(capacities), []
    for size, n in runs:
        parts = []
        while n:
            got = bins.place(size, n)
            if got is None:
                return None
            parts.append(got)
            n -= got[1]
        placed.append(parts)
    return placed


def pack(runs: list[tuple[float, int]], shards: int) -> list[list[tuple[int, int]]]:
    """Best fit at the least capacity, to a hundred-thousandth, that needs no more than ``shards`` bins.

    A single group larger than a fair share of what is left has a bin of its own. A capacity of a fair share plus the
    largest size always suffices, so the search for the least one starts there.
    """
    total, own = sum(s * n for s, n in runs), []
    while len(own) < shards - 1 and len(own) < len(runs) and runs[len(own)][1] == 1:
        size = runs[len(own)][0]
        if size * (shards - len(own)) <= total:
            break
        own.append([(len(own), 1)])
        total -= size
    rest, left = runs[len(own) :], shards - len(own)
    if not rest:
        return own
    low, high = total / left, total / left + rest[0][0]
    best = fit(rest, [high] * left)
    while high - low > 1e-5 * high:
        middle = (low + high) / 2
        got = fit(rest, [middle] * left)
        low, high, best = (middle, high, best) if got is None else (low, middle, got)
    return own + [[(b + len(own), k) for b, k in parts] for parts in best]


def _class_of(weight: Column) -> Column:
    return F.floor(F.log(weight.cast("double")) / math.log(CLASS_STEP)).cast("int")


def ranked(df: DataFrame, within: str, spread: Column, rows: int, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2 .. within each value of ``within``, by buckets so that no value is ranked in one task."""
    buckets = max(64, -(-rows // RANK_ROWS))
    put = df.withColumn("_b", F.pmod(spread, F.lit(buckets)).cast("int"))
    counts = put.groupBy(within, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(within, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(within, "_b").orderBy(spread))
    own = put.withColumn("_r", place)
    return own.join(offsets, [within, "_b"]).withColumn(name, F.col("_o") + F.col("_r") - 1).drop("_b", "_o", "_r")


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, shard and slot; documents of equal text share a shard."""
    spark = docs.sparkSession
    facts = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),  # written with the facts: tells rows of one id, or of none, apart
        group_key(F.col("text")).alias("g"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
    )
    facts = materialize(facts, "shard-facts")
    groups = materialize(facts.groupBy("g").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n_docs")), "shard-groups")
    total, n_groups, n_docs = groups.agg(F.sum("w"), F.count(F.lit(1)), F.sum("n_docs")).first()
    if not n_groups:
        return facts.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    single = max(2, int(total / shards * SINGLE_PART))
    small = groups.where(F.col("w") < single).withColumn("cls", _class_of(F.col("w")))
    large = groups.where(F.col("w") >= single)  # at most shards / SINGLE_PART of them
    singles = sorted(((r["w"], bytes(r["g"]), r["n_docs"]) for r in large.collect()), reverse=True)
    classes = sorted(
        ((r["top"], r["n"], r["cls"]) for r in small.groupBy("cls").agg(F.max("w").alias("top"), F.count(F.lit(1)).alias("n")).collect()),
        reverse=True,
    )
    placed = pack([(w, 1) for w, _, _ in singles] + [(top, n) for top, n, _ in classes], shards)
    one_by_one = [(g, n, parts[0][0]) for (_, g, n), parts in zip(singles, placed, strict=False)]
    intervals = []
    for (_, _, cls), parts in zip(classes, placed[len(singles) :], strict=True):
        start = 0
        for b, k in parts:
            intervals.append((cls, start, start + k, b))
            start += k
    of_large = spark.createDataFrame(one_by_one, "g binary, n_docs long, shard int")
    of_small = spark.createDataFrame(intervals, "cls int, start long, stop long, shard int")
    in_class = ranked(small.select("g", "n_docs", "cls"), "cls", F.xxhash64("g"), n_groups, "rank")
    # at most a few intervals for each of at most log(total) / log(CLASS_STEP) classes: bounded whatever the input
    spread = in_class.join(F.broadcast(of_small), "cls").where("rank >= start and rank < stop").select("g", "n_docs", "shard")
    chosen = materialize(spread.unionByName(of_large), "shard-of-group")
    put = spread_join(facts, chosen, ["g"], "n_docs", n_docs, F.col("row")).drop("n_docs")
    placed_docs = ranked(put, "shard", F.xxhash64("row"), n_docs, "slot")
    return placed_docs.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The contract's rows: law ``bytes``, so there is no shard after growth."""
    return assign_shards(docs.select("doc_id", "text"), shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
