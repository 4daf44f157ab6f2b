"""Bars: roll-up of ticks and of bars, gap audit and fill, spacing, closed bars and first-seen rows.

A bar table has series, time (epoch seconds of the open), open, high, low, close, volume and trades. Ticks are
aggregated before they are shuffled, so a hot series costs one row for each task and bar; window expressions run on bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bars a year where the spacing cannot be told: five-minute bars, with a year of 365.25 days.
FALLBACK_BARS = 105_120
YEAR_SECONDS = 365.25 * 86400


def by_time(*keys: str, order: str = "time"):
    return Window.partitionBy(*(keys or ("series",))).orderBy(order)


def tumbling(ticks: DataFrame, seconds: int) -> DataFrame:
    """Bars of a fixed length; open and close by (time, seq)."""
    at = F.struct("time_ms", "seq")
    return (
        ticks.withColumn("time", F.floor(F.col("time") / seconds) * seconds)
        .groupBy("series", "time")
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("trades"),
        )
    )


def indexed(bars: DataFrame, name: str = "idx") -> DataFrame:
    return bars.withColumn(name, F.row_number().over(by_time()) - 1)


def rollup(bars: DataFrame, factor: int) -> DataFrame:
    """``factor`` bars at a time, by position; an incomplete last group goes."""
    if factor <= 1:
        return bars
    return (
        indexed(bars)
        .groupBy("series", F.floor(F.col("idx") / factor).alias("group"))
        .agg(
            F.min("time").alias("time"),
            F.min_by("open", "idx").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "idx").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n"),
        )
        .where(F.col("n") == factor)
        .select("series", "time", "open", "high", "low", "close", "volume")
    )


def missing_before(seconds: int) -> Column:
    """Bars that are missing since the one before, none for the first."""
    step = (F.col("time") - F.lag("time").over(by_time())) / F.lit(float(seconds))
    return F.coalesce(F.greatest(F.floor(step + 0.5) - 1, F.lit(0)), F.lit(0))


def gap_audit(bars: DataFrame, seconds: int) -> DataFrame:
    return (
        bars.withColumn("missing", missing_before(seconds))
        .groupBy("series")
        .agg(
            F.count(F.lit(1)).alias("bars"),
            F.sum("missing").cast("long").alias("gaps"),
            F.max("missing").cast("long").alias("largest_gap"),
        )
    )


def fill_gaps(bars: DataFrame, seconds: int, max_fill: int = 12) -> DataFrame:
    """Flat bars without volume where at most ``max_fill`` are missing; longer runs stay open. ``filled`` marks them."""
    gap = bars.withColumn("missing", missing_before(seconds)).withColumn("prev", F.lag("close").over(by_time()))
    gap = gap.withColumn("prev_time", F.lag("time").over(by_time()))
    flat = gap.where(F.col("missing").between(1, max_fill)).select(
        "series",
        F.explode(F.sequence(F.lit(1), F.col("missing").cast("int"))).alias("k"),
        "prev",
        "prev_time",
    )
    price = [F.col("prev").alias(c) for c in ("open", "high", "low", "close")]
    flat = flat.select(
        "series", (F.col("prev_time") + F.col("k") * seconds).alias("time"), *price, F.lit(0.0).alias("volume"), F.lit(True).alias("filled")
    )
    own = bars.select("series", "time", "open", "high", "low", "close", "volume", F.lit(False).alias("filled"))
    return own.unionByName(flat)


def gap_fill_counts(bars: DataFrame, seconds: int, max_fill: int = 12) -> DataFrame:
    """Bars filled and bars left open by :func:`fill_gaps`."""
    gap = bars.withColumn("missing", missing_before(seconds))
    fits = F.col("missing") <= max_fill
    return gap.groupBy("series").agg(
        F.sum(F.when(fits, F.col("missing")).otherwise(0)).cast("long").alias("filled"),
        F.sum(F.when(~fits, F.col("missing")).otherwise(0)).cast("long").alias("skipped"),
    )


def median_spacing(bars: DataFrame) -> DataFrame:
    """Upper median of the spacing and the bars a year it means; the fallback for few bars or an odd spacing."""
    steps = bars.withColumn("step", F.col("time") - F.lag("time").over(by_time())).where("step is not null")
    place = Window.partitionBy("series").orderBy("step", "time")
    ranked = steps.withColumn("k", F.row_number().over(place) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series")))
    middle = ranked.where(F.col("k") == F.floor(F.col("n") / 2)).select("series", F.col("step").alias("median_step"), "n")
    usable = (F.col("n") + 1 >= 10) & (F.col("median_step") > 0) & (F.col("median_step") <= 31 * 86400)
    return middle.select(
        "series",
        "median_step",
        F.when(usable, YEAR_SECONDS / F.col("median_step")).otherwise(float(FALLBACK_BARS)).alias("bars_per_year"),
    )


def closed_bars(bars: DataFrame, seconds: int, now: Column | int) -> DataFrame:
    """Bars that have ended by ``now``."""
    return bars.where(F.col("time") + seconds <= F.floor(F.lit(now) if isinstance(now, int) else now))


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("series").orderBy(F.col("time").desc())
    return bars.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def first_seen(rows: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row for each key, the first (or last) by ``order``, with the number of rows it stands for as ``copies``."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"), F.count(F.lit(1)).alias("copies"))
    return one.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest), "copies")
