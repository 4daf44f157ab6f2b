"""Connected components of links by alternating star contraction: joins and minima only, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, spread_join

#: Links that one task can hold: where there are more in all, those of a hot node are split.
TASK_LINKS = 200_000


def _joined(links: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``links`` with the columns of ``least``, a row for each u with its number of links (rows)."""
    if n <= TASK_LINKS:
        return links.join(least, "u")
    return spread_join(links, materialize(least, "links-least"), ["u"], "rows", n, F.col("v"))


def _large_star(links: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours go to the least node round it."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("rows"))
    return _joined(both.where("v > u"), least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows"))
    moved = _joined(down, least, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in ``links`` (u, v) that is not its own component."""
    now = materialize(links.where("u <> v").select("u", "v").distinct(), "links")
    before = None
    while before != (digest := _digest(now)):
        before, old = digest, now
        now = materialize(_small_star(_large_star(old, digest[0]), digest[0]), "links")
        discard(old)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
