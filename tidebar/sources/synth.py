"""Synthetic series with known regimes, one group each: a rare violent rise, a long decline, and quiet most of the time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Moves between the regimes decline, quiet and rise, and what each does to price and volume.
MOVES = np.array([[0.94, 0.06, 0.00], [0.02, 0.96, 0.02], [0.06, 0.16, 0.78]])
DRIFT = np.array([-0.0035, 0.0000, 0.0090])
VOLATILITY = np.array([0.030, 0.011, 0.055])
VOLUME = np.array([1.6, 1.0, 4.2])
START, STEP, SHOCK, SHOCK_SIZE = 1_735_689_600, 300, 0.08, 3.0
_BARS = "series string, time long, open double, high double, low double, close double, volume double, true_state int"


def _series(name: str, bars: int, seed: int, price: float) -> pd.DataFrame:
    rng = np.random.Generator(np.random.Philox(key=seed))
    u, z, state = rng.random(bars), np.empty(bars, int), 1
    steps = np.cumsum(MOVES, 1)
    for i in range(bars):
        state = min(int(np.searchsorted(steps[state], u[i])), 2)
        z[i] = state
    shock = np.where(rng.random(bars) < SHOCK, SHOCK_SIZE, 1.0)
    r = DRIFT[z] + VOLATILITY[z] * shock * rng.standard_normal(bars)
    close = np.maximum(price * np.exp(np.cumsum(r)), 1e-12)
    opened = np.append(price, close[:-1])
    wick = VOLATILITY[z] * np.abs(rng.standard_normal(bars)) / 2
    high, low = np.maximum(opened, close) * (1 + wick), np.minimum(opened, close) * (1 - wick)
    volume = 50_000 * VOLUME[z] * np.exp(0.6 * rng.standard_normal(bars))
    return pd.DataFrame({"series": name, "time": START + STEP * np.arange(bars), "open": opened, "high": high, "low": low, "close": close, "volume": volume, "true_state": z})


def synthetic_bars(spark: SparkSession, series: int = 1, bars: int = 6000, seed: int = 7, price: float = 1e-4) -> DataFrame:
    """``series`` series named s0, s1 ..; the same for the same seed, however many there are."""
    names = spark.range(series).select(F.concat(F.lit("s"), F.col("id")).alias("series"), "id")
    return names.groupBy("series").applyInPandas(lambda r: _series(r["series"].iloc[0], bars, seed + int(r["id"].iloc[0]), price), _BARS)
