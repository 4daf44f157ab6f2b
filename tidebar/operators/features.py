"""Causal price features, the scaler that is fitted on training rows only, and clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import by_time, indexed

#: Trailing bars of a feature window, and the floors of its logarithms.
WINDOW, FLOOR, TINY = 5, 1e-18, 1e-8
PRICE_FEATURES = ("log_return", "realized_vol", "volume_surge")


def log_return() -> Column:
    before = F.lag("close").over(by_time())
    return F.coalesce(F.log(F.greatest("close", F.lit(FLOOR)) / F.greatest(before, F.lit(FLOOR))), F.lit(0.0))


def price_features(bars: DataFrame, window: int = WINDOW) -> DataFrame:
    """series, row, idx, time, close and the three features; the first ``window`` bars only warm up.

    Series of fewer than ``window + 2`` bars have no rows. One sort by (series, time) serves all window expressions.
    """
    trailing = by_time().rowsBetween(-(window - 1), 0)
    traded = F.greatest("volume", F.lit(0.0))
    every = indexed(bars).withColumn("log_return", log_return())
    every = (
        every.withColumn("realized_vol", F.log(F.stddev_pop("log_return").over(trailing) + TINY))
        .withColumn("volume_surge", F.log((traded + TINY) / (F.avg(traded).over(trailing) + TINY)))
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series")))
    )
    return every.where((F.col("idx") >= window) & (F.col("n") >= window + 2)).select(
        "series", (F.col("idx") - window).alias("row"), "idx", "time", "close", *PRICE_FEATURES
    )


def fit_scaler(features: DataFrame, names: tuple[str, ...], train: Column) -> DataFrame:
    """Mean and population deviation (1e-12 at least) of each feature over the training rows of each series."""
    stats = [F.avg(c).alias(f"{c}_mean") for c in names] + [F.greatest(F.stddev_pop(c), F.lit(1e-12)).alias(f"{c}_sd") for c in names]
    return features.where(train).groupBy("series").agg(*stats)


def scale(features: DataFrame, scaler: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Standardised features; a scaler has one row a series, whose size is checked by the planner."""
    scaled = {c: ((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")) for c in names}
    return features.join(scaler, "series").select(*(scaled[c].alias(c) if c in scaled else F.col(c) for c in features.columns))


def unscaled(value: Column, name: str) -> Column:
    """A standardised value of a feature in its own units; the scaler's columns are at hand."""
    return value * F.col(f"{name}_sd") + F.col(f"{name}_mean")


def clip(features: DataFrame, names: tuple[str, ...], sigmas: float = 3.0) -> DataFrame:
    """Each feature held within so many population deviations of its mean over the series."""
    bounds = features.groupBy("series").agg(
        *(F.avg(c).alias(f"{c}_mid") for c in names), *(F.stddev_pop(c).alias(f"{c}_dev") for c in names)
    )
    held = {c: F.least(F.greatest(F.col(c), F.col(f"{c}_mid") - sigmas * F.col(f"{c}_dev")), F.col(f"{c}_mid") + sigmas * F.col(f"{c}_dev")) for c in names}
    return features.join(bounds, "series").select(*(held[c].alias(c) if c in held else F.col(c) for c in features.columns))


def next_return(features: DataFrame, spacing: int | None = None) -> DataFrame:
    """Adds next_return, the log return of the next row; null at the end, or where the next bar is not ``spacing`` away."""
    w = by_time()
    ahead = F.lead("log_return").over(w)
    if spacing is not None:
        ahead = F.when(F.lead("time").over(w) - F.col("time") == spacing, ahead)
    return features.withColumn("next_return", ahead)


def forward_cumulative(rows: DataFrame, value: str, horizon: int, name: str = "forward") -> DataFrame:
    """Compounded return of this row and the next ``horizon - 1``; null unless all are there and not null."""
    frame = by_time().rowsBetween(0, horizon - 1)
    full = (F.count(value).over(frame) == horizon) & (F.count(F.lit(1)).over(frame) == horizon)
    return rows.withColumn(name, F.when(full, F.product(F.lit(1) + F.col(value)).over(frame) - 1))
