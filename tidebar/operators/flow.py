"""Features that are no prices: rolling scores of prints on their own grid, carried to bars, and scores of the tape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import align_step
from .bars import by_time
from .features import TINY

FLAT = 1e-12


def rolling_z(value: str, window: int, order: str = "time") -> Column:
    """Trailing z-score with the current row; 0 where the window is flat, null until it is full."""
    w = by_time(order=order).rowsBetween(-(window - 1), 0)
    sd = F.stddev_pop(value).over(w)
    z = F.when(sd > FLAT, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)
    return F.when(F.count(F.lit(1)).over(w) == window, z)


def rolling_sum(value: str, window: int, order: str = "time") -> Column:
    w = by_time(order=order).rowsBetween(-(window - 1), 0)
    return F.when(F.count(F.lit(1)).over(w) == window, F.sum(value).over(w))


def count_surge(window: int) -> Column:
    w = by_time().rowsBetween(-(window - 1), 0)
    n = F.greatest(F.col("trades"), F.lit(0))
    return F.when(F.count(F.lit(1)).over(w) == window, F.log((n + TINY) / (F.sum(n).over(w) / window + TINY)))


def size_z(window: int) -> Column:
    """z-score of the log size of a trade over the bars of the window that have trades, two at least."""
    w = by_time().rowsBetween(-(window - 1), 0)
    size = F.when((F.col("trades") > 0) & (F.col("volume") > 0), F.log(F.col("volume") / F.col("trades")))
    sd = F.stddev_pop(size).over(w)
    z = F.when(sd > FLAT, (size - F.avg(size).over(w)) / sd).otherwise(0.0)
    full = (F.count(F.lit(1)).over(w) == window) & (F.count(size).over(w) >= 2) & size.isNotNull()
    return F.when(full, z)


def print_scores(prints: DataFrame, z_window: int = 168, carry_window: int = 24) -> DataFrame:
    """funding_bps, funding_z, carry_bps, premium_bps and premium_z of prints (series, time_ms, rate, premium)."""
    return prints.select(
        "series",
        "time_ms",
        (F.col("rate") * 1e4).alias("funding_bps"),
        rolling_z("rate", z_window, "time_ms").alias("funding_z"),
        (rolling_sum("rate", carry_window, "time_ms") * 1e4).alias("carry_bps"),
        (F.col("premium") * 1e4).alias("premium_bps"),
        rolling_z("premium", z_window, "time_ms").alias("premium_z"),
    )


PRINT_COLUMNS = ("funding_bps", "funding_z", "carry_bps", "premium_bps", "premium_z")
TAPE_COLUMNS = ("trade_count_surge", "avg_trade_size_z")


def flow_columns(bars: DataFrame, prints: DataFrame, seconds: int, window: int = 20, z_window: int = 168, carry_window: int = 24, stale_hours: int = 3) -> DataFrame:
    """All flow columns at each bar, null where not known, and ``valid`` where all are.

    Scores are null only before their window has filled, so the newest print has them all or nothing has them: one as-of
    join carries all of them.
    """
    scores = print_scores(prints, z_window, carry_window)
    stale = stale_hours * 3_600_000 + seconds * 1000
    own = bars.select("series", "time", count_surge(window).alias(TAPE_COLUMNS[0]), size_z(window).alias(TAPE_COLUMNS[1]))
    out = own.join(align_step(bars, scores, seconds, stale, PRINT_COLUMNS).drop("age_ms"), ["series", "time"])
    names = [*PRINT_COLUMNS, *TAPE_COLUMNS]
    return out.select("series", "time", *names, reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in names)).alias("valid"))


def trim_leading(columns: DataFrame) -> DataFrame:
    """Rows from the first valid one of each series; a later row that is not valid is an error."""
    first = columns.where("valid").groupBy("series").agg(F.min("time").alias("_from"))
    kept = columns.join(first, "series").where("time >= _from").drop("_from")
    return kept.withColumn("valid", F.when(~F.col("valid"), F.raise_error(F.lit("a flow column has a hole after its first value")).cast("boolean")).otherwise(True))


def augment(features: DataFrame, columns: DataFrame, names: list[str]) -> DataFrame:
    """Feature rows with more columns from the bar they stand at.

    A name that is there already is an error, and so is a value that is missing or not finite; rows of bars without
    columns go, as those of the time before a flow is known.
    """
    clash = sorted(set(names) & set(features.columns))
    if clash:
        raise ValueError(f"these columns are there already: {', '.join(clash)}")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    sound = [F.when(bad(c), F.raise_error(F.lit(f"{c} has a value that is missing or not finite")).cast("double")).otherwise(F.col(c)).alias(c) for c in names]
    return features.join(columns.select("series", "time", *sound), ["series", "time"])
