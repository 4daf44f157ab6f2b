"""Alignment: strict as-of with tolerance, completed higher bars, range sums, panels and bucket grids.

The as-of join sorts both sides together and carries the newest point forward in two levels: within blocks of time, and
from block to block by a table with one row a block. So a series that holds most rows is many tasks, not one, and the
work is a sort, never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import by_time, indexed

#: Milliseconds of a block of the as-of sort; seconds of a block of times that are numbered together.
BLOCK_MS, BLOCK_SECONDS = 7 * 86_400_000, 7 * 86_400


def numbered_times(rows: DataFrame, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """time, i and n: the different times of ``rows`` in order, numbered from 0, and how many there are.

    They are numbered within blocks, so only one row a block passes the window that has no key.
    """
    times = rows.select("time").distinct().withColumn("_block", F.floor(F.col("time") / seconds))
    below = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = times.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"), F.sum("_n").over(every).alias("n"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy("time")) - 1
    return times.withColumn("_place", place).join(blocks, "_block").select("time", (F.col("_below") + F.col("_place")).alias("i"), "n")


def as_of_strict(left: DataFrame, points: DataFrame, at: str, values: tuple[str, ...] = ("value",), block_ms: int = BLOCK_MS) -> DataFrame:
    """``left`` (series, ``at`` in ms, ..) with the newest of ``points`` (series, time_ms and ``values``) before ``at``.

    Adds the values and point_ms, null where there is none. Of points with equal stamps the largest by values counts.
    """
    rest = [c for c in left.columns if c not in ("series", at)]
    point = F.struct(F.col("time_ms").cast("long").alias("ms"), *(F.col(v).cast("double").alias(v) for v in values))
    given = points.select("series", F.col("time_ms").cast("long").alias("_ms"), F.lit(1).alias("_side"), point.alias("_point"))
    kind = given.schema["_point"].dataType
    asked = left.select("series", F.col(at).cast("long").alias("_ms"), F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_point"), F.struct(*(rest or [F.lit(1).alias("_")])).alias("_rest"))
    both = asked.unionByName(given, allowMissingColumns=True).withColumn("_block", F.floor(F.col("_ms") / block_ms))
    inside = Window.partitionBy("series", "_block").orderBy("_ms", "_side", "_point").rowsBetween(Window.unboundedPreceding, 0)
    newest = given.groupBy("series", F.floor(F.col("_ms") / block_ms).alias("_block")).agg(F.max("_point").alias("_last"))
    earlier = Window.partitionBy("series").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.select("series", "_block").distinct().join(newest, ["series", "_block"], "left")
    carried = blocks.select("series", "_block", F.last("_last", True).over(earlier).alias("_carried"))
    found = both.withColumn("_own", F.last("_point", True).over(inside)).where("_side = 0").join(carried, ["series", "_block"])
    best = F.coalesce("_own", "_carried")
    kept = (F.col(f"_rest.{c}").alias(c) for c in rest)
    return found.select("series", F.col("_ms").alias(at), *kept, *(best[v].alias(v) for v in values), best["ms"].alias("point_ms"))


def align_step(bars: DataFrame, points: DataFrame, seconds: int, max_stale_ms: int, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """For each bar the newest point stamped before its close, null where it is older than ``max_stale_ms``, and its age."""
    closes = bars.select("series", "time", ((F.col("time") + seconds) * 1000).alias("close_ms"))
    found = as_of_strict(closes, points, "close_ms", values)
    age = F.col("close_ms") - F.col("point_ms")
    fresh = age <= max_stale_ms
    return found.select("series", "time", *(F.when(fresh, F.col(v)).alias(v) for v in values), F.when(fresh, age).alias("age_ms"))


def completed_bar(base: DataFrame, higher: DataFrame, factor: int, values: list[str]) -> DataFrame:
    """Each base bar with ``values`` of the last higher bar that has ended by its close: an equi-join on a computed index."""
    own = indexed(base).withColumn("higher_idx", F.floor((F.col("idx") + 1) / factor) - 1)
    top = indexed(higher, "higher_idx").select("series", F.col("higher_idx").cast("long"), *(F.col(c).alias(f"higher_{c}") for c in values))
    return own.join(top, ["series", "higher_idx"], "left").withColumn("ready", F.col(f"higher_{values[0]}").isNotNull())


def range_sum(bars: DataFrame, prints: DataFrame, value: str = "rate") -> DataFrame:
    """Sum of the prints in (time, next time] of each bar but the last: each print finds its bar by a strict as-of."""
    points = bars.select("series", (F.col("time") * 1000).alias("time_ms"), F.col("time").cast("double").alias("value"))
    placed = as_of_strict(prints.select("series", "time_ms", value), points, "time_ms").where("value is not null")
    sums = placed.groupBy("series", F.col("value").cast("long").alias("time")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("prints"))
    ahead = F.lead("time").over(by_time())
    held = bars.select("series", "time").withColumn("next_time", ahead).where("next_time is not null")
    return held.join(sums, ["series", "time"], "left").select(
        "series", "time", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("prints", F.lit(0)).alias("prints")
    )


def align_panel(rows: DataFrame, values: list[str]) -> DataFrame:
    """Every series at every time that any series has, null where it has no row; the panel is that product by definition."""
    axis = rows.select("time").distinct().crossJoin(rows.select("series").distinct())
    return axis.join(rows.select("series", "time", *values), ["series", "time"], "left")


def bucket_grid(rows: DataFrame, value: str, seconds: int) -> DataFrame:
    """Sums of ``value`` in buckets, on one dense grid from the first to the last bucket of all series."""
    sums = rows.groupBy("series", F.floor(F.col("time") / seconds).alias("bucket")).agg(F.sum(value).alias(value))
    span = sums.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null")
    grid = span.select(F.explode(F.sequence("a", "b")).alias("bucket")).crossJoin(sums.select("series").distinct())
    return grid.join(sums, ["series", "bucket"], "left").select(
        "series", (F.col("bucket") * seconds).alias("time"), F.coalesce(value, F.lit(0.0)).alias(value)
    )


def price_at(bars: DataFrame, times: DataFrame) -> DataFrame:
    """The close of the last bar at or before each of ``times`` (series, at), else of the first bar."""
    points = bars.select("series", (F.col("time") * 1000).alias("time_ms"), F.col("close").alias("value"))
    found = as_of_strict(times.select("series", "at", (F.col("at") * 1000 + 1).alias("at_ms")), points, "at_ms")
    first = bars.groupBy("series").agg(F.min_by("close", "time").alias("first_close"))
    return found.join(first, "series").select("series", "at", F.coalesce("value", "first_close").alias("price"))
