"""Every rotation of a strategy's positions at once, by circular cross-correlation.

What a rotation earns is a sum over bars of what the bar gives for the pair of positions (before, now) that the rotation puts
there. For each pair of values that occurs, the sum over bars for all shifts is the correlation of where the pair stands with
what it would earn, so all n rotations cost a few transforms of length n instead of n passes over the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BPS = 1e-4
#: Pairs of positions up to which transforms are used; positions of many different sizes are turned one shift at a time.
MOST_PAIRS = 64


def correlation(there: np.ndarray, gives: np.ndarray) -> np.ndarray:
    """sum over i of there[(i + s) mod n] * gives[i], for each s."""
    return np.fft.irfft(np.fft.rfft(there) * np.conj(np.fft.rfft(gives)), len(there))


def growths(position: np.ndarray, ret: np.ndarray, cost: float) -> np.ndarray:
    """Compounded return of each rotation, 0 (none) to n - 1; each begins without a position."""
    n = len(position)
    before = np.roll(position, 1)
    pairs, code = np.unique(np.stack([before, position], 1), axis=0, return_inverse=True)
    code = code.ravel()
    first = np.abs(position) * cost
    net = lambda now, turn, r: 1 + now * r - turn
    factors = net(pairs[:, 1, None], np.abs(pairs[:, 1] - pairs[:, 0])[:, None] * cost, ret[None])
    opening = net(position, first, ret[0])
    if len(pairs) > MOST_PAIRS or factors.min() <= 0 or opening.min() <= 0:
        return np.array([np.prod(np.append(opening[s], factors[np.roll(code, -s)[1:], np.arange(1, n)])) for s in range(n)]) - 1
    logs = np.log(factors)
    total = sum(correlation((code == k).astype(float), logs[k]) for k in range(len(pairs)))
    return np.exp(total - logs[code, 0] + np.log(opening)) - 1


def nets(position: np.ndarray, ret: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Sum of net returns and number of observations of each rotation; NaN on either side is no observation.

    A position is changed from the last one that is known, and the first one of a rotation from none.
    """
    n = len(position)
    held, known = np.flatnonzero(np.isfinite(position)), np.isfinite(ret)
    if not len(held):
        return np.zeros(n), np.zeros(n, np.int64)
    there = np.isfinite(position).astype(float)
    p, turn = np.where(there > 0, position, 0.0), np.zeros(n)
    turn[held] = np.abs(p[held] - np.roll(p[held], 1))
    seen = known.astype(float)
    total = correlation(p, np.where(known, ret, 0.0)) - cost * correlation(turn, seen)
    count = np.rint(correlation(there, seen)).astype(np.int64)
    shift = np.arange(n)
    first = held[np.searchsorted(held, shift) % len(held)]
    total -= np.where(known[(first - shift) % n], cost * (np.abs(p[first]) - turn[first]), 0.0)
    return np.where(count > 0, total, 0.0), count


def rotations(rows: DataFrame, cost_bps: float) -> DataFrame:
    """series, exposure and totals: the compounded return of each rotation of a series, the first one as it was."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        position = rows["position"].to_numpy(float)
        found = growths(position, rows["ret"].to_numpy(float), cost_bps * BPS)
        return pd.DataFrame({"series": rows["series"].iloc[:1], "exposure": [(np.abs(position) > 1e-9).mean()], "totals": [found]})

    return rows.select("series", "row", "position", "ret").groupBy("series").applyInPandas(run, "series string, exposure double, totals array<double>")


def panel_rotations(panel: DataFrame, cost_bps: float) -> DataFrame:
    """series, n, shift, net and seen: sum of net returns and observations of each rotation of each series of an aligned panel."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("time")
        total, count = nets(rows["position"].to_numpy(float), rows["ret"].to_numpy(float), cost_bps * BPS)
        return pd.DataFrame({"series": rows["series"].iloc[0], "n": len(rows), "shift": np.arange(len(rows)), "net": total, "seen": count})

    return panel.select("series", "time", "position", "ret").groupBy("series").applyInPandas(run, "series string, n long, shift long, net double, seen long")


def exact_p(totals, actual) -> list:
    """shifts and p_exact: how many rotations there are but none, and the share of them that does as well."""
    others = F.slice(totals, 2, F.greatest(F.size(totals) - 1, F.lit(1)))
    beat = F.size(F.filter(others, lambda t: t >= actual - 1e-12 * (1 + F.abs(actual))))
    return [F.size(others).cast("long").alias("shifts"), (beat / F.nullif(F.size(others), F.lit(0))).alias("p_exact")]


def rotation_exact(rows: DataFrame, cost_bps: float) -> DataFrame:
    """series, actual, shifts and p_exact: the actual return against all rotations of it, none left to chance."""
    found = rotations(rows, cost_bps).withColumn("actual", F.col("totals")[0])
    return found.select("series", "actual", *exact_p(F.col("totals"), F.col("actual")))


def panel_exact(panel: DataFrame, cost_bps: float) -> DataFrame:
    """observations, actual_bps, shifts and p_exact of the pooled statistic against all rotations common to all series."""
    each = panel_rotations(panel, cost_bps).groupBy("shift").agg((F.sum("net") / F.nullif(F.sum("seen"), F.lit(0)) * 1e4).alias("bps"), F.sum("seen").alias("seen"))
    actual = each.where("shift = 0").select(F.col("bps").alias("actual_bps"), F.col("seen").alias("observations"))
    others = each.where("shift > 0").join(F.broadcast(actual))
    near = 1e-9 * (1 + F.abs("actual_bps"))
    return others.groupBy("observations", "actual_bps").agg(
        F.count(F.lit(1)).alias("shifts"), (F.count_if(F.col("bps") >= F.col("actual_bps") - near) / F.count(F.lit(1))).alias("p_exact")
    )
