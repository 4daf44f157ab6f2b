"""How much data an edge needs: closed forms over one specification, for tables of them.

Here the cost is that of a round trip, unlike everywhere else.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import normal_cdf, normal_inv

YEAR = 365.25


@dataclass(frozen=True)
class Edge:
    edge_bps: float
    hold: float
    vol_bps: float
    cost_bps: float
    exposure: float = 1.0
    bars_per_day: float = 48.0


def sharpe_per_trade(e: Edge) -> float:
    return (e.edge_bps * e.hold - e.cost_bps) / (e.vol_bps * math.sqrt(e.hold))


def trades_needed(e: Edge, alpha: float = 0.05, power: float = 0.8, inflation: float = 1.0) -> float:
    """Independent trades for a one-sided test; infinite without an edge after costs."""
    sr = sharpe_per_trade(e)
    if sr <= 0:
        return math.inf
    return ((normal_inv(1 - alpha) + normal_inv(power) * math.sqrt(1 + sr * sr / 2)) / sr) ** 2 * inflation


def bars_needed(e: Edge, **options: float) -> float:
    return trades_needed(e, **options) * e.hold / e.exposure


def days_needed(e: Edge, **options: float) -> float:
    return bars_needed(e, **options) / e.bars_per_day


def power_at(e: Edge, bars: float, alpha: float = 0.05, series: float = 1.0) -> float:
    """Chance to see the edge in so many bars of so many independent series."""
    sr, trades = sharpe_per_trade(e), bars * series * e.exposure / e.hold
    return normal_cdf((sr * math.sqrt(trades) - normal_inv(1 - alpha)) / math.sqrt(1 + sr * sr / 2))


def detectable_edge(e: Edge, bars: float, alpha: float = 0.05, power: float = 0.8, series: float = 1.0) -> float:
    """The smallest edge a bar, in basis points, that so many bars show with that power: solved for the Sharpe of a trade."""
    trades = bars * series * e.exposure / e.hold
    za, zb = normal_inv(1 - alpha), normal_inv(power)
    low, high = 0.0, 50.0
    for _ in range(200):
        sr = (low + high) / 2
        low, high = (sr, high) if sr * math.sqrt(trades) < za + zb * math.sqrt(1 + sr * sr / 2) else (low, sr)
    return (high * e.vol_bps * math.sqrt(e.hold) + e.cost_bps) / e.hold


def t_required(tests: int, alpha: float = 0.05) -> float:
    """The t that one of ``tests`` independent tests needs for a family-wise level."""
    return normal_inv(1 - alpha / tests)


def effective_series(n: float, rho: float) -> float:
    """Independent series that n series of mean correlation rho are worth; it tends to 1 / rho."""
    return n / (1 + (n - 1) * min(max(rho, 0.0), 0.999))


def effective_series_limit(rho: float) -> float:
    return math.inf if rho <= 0 else 1 / min(rho, 0.999)


def variance_inflation(rho: float, q: int) -> float:
    """Variance of a sum of q autocorrelated bars, over that of independent ones."""
    return (q + 2 * sum((q - k) * rho**k for k in range(1, q))) / q


def break_even(cost_bps: float, hold: float) -> float:
    """The edge a bar that just pays for a round trip."""
    return cost_bps / max(hold, 1e-12)


def trades_a_year(e: Edge) -> float:
    return e.exposure * e.bars_per_day * YEAR / e.hold


def implied_annual_sharpe(e: Edge) -> float:
    return sharpe_per_trade(e) * math.sqrt(trades_a_year(e))


def years_required(sharpe: float, alpha: float = 0.05, power: float = 0.8) -> float:
    """Years that an annual Sharpe takes to show, whatever the length of a bar; infinite for none."""
    return ((normal_inv(1 - alpha) + normal_inv(power)) / sharpe) ** 2 if sharpe > 0 else math.inf


def annual_sharpe_required(years: float, alpha: float = 0.05, power: float = 0.8) -> float:
    return (normal_inv(1 - alpha) + normal_inv(power)) / math.sqrt(max(years, 1e-12))


def permutation_trials_required(alpha: float) -> tuple[int, int]:
    """Trials whose smallest p-value reaches ``alpha``, and ten times as many, with which it is stable."""
    least = math.ceil(1 / alpha)
    return least, 10 * least


def table(rows: DataFrame, base: Edge) -> DataFrame:
    """Closed forms for a table of edges (edge_bps, hold), the rest as in ``base``; infinite where no data would do."""
    names = ["break_even_bps", "sharpe_per_trade", "trades", "bars", "days", "annual_sharpe", "years"]

    def run(batches):
        for batch in batches:
            out = []
            for edge, hold in zip(batch.edge_bps, batch.hold):
                e = replace(base, edge_bps=edge, hold=hold)
                annual = implied_annual_sharpe(e)
                out.append((edge, hold, break_even(e.cost_bps, hold), sharpe_per_trade(e), trades_needed(e), bars_needed(e), days_needed(e), annual, years_required(annual)))
            yield pd.DataFrame(out, columns=["edge_bps", "hold", *names])

    return rows.select("edge_bps", "hold").mapInPandas(run, ", ".join(f"{c} double" for c in ["edge_bps", "hold", *names]))


def experiment(e: Edge, bars: int, rng: np.random.Generator, drift_bps: float = 0.0, idle_vol_bps: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and returns of one imagined record: holds of one length, gaps that give the exposure, the edge while held."""
    hold, gap = int(e.hold), max(1, round(e.hold * (1 / e.exposure - 1)))
    position = (np.arange(bars) % (hold + gap) < hold).astype(float)
    spread = np.where(position > 0, e.vol_bps, e.vol_bps if idle_vol_bps is None else idle_vol_bps)
    return position, (drift_bps + position * e.edge_bps + spread * rng.standard_normal(bars)) * 1e-4


def permutation_power(spark: SparkSession, e: Edge, bars: int, experiments: int = 200, trials: int = 300, shuffle: bool = False, alpha: float = 0.05, seed: int = 1, **options: float) -> DataFrame:
    """One row: how often the rotation (or shuffle) test sees the edge, and its median p-value. An experiment is a row, tasks run them."""
    cost = e.cost_bps * 1e-4 / 2  # a side

    def earned(positions: np.ndarray, returns: np.ndarray) -> np.ndarray:
        turn = np.abs(np.diff(positions, axis=1, prepend=0)).sum(1)
        return positions @ returns - cost * turn

    def run(batches):
        for batch in batches:
            out = []
            for k in batch.id:
                rng = np.random.default_rng([seed, int(k)])
                held, returns = experiment(e, bars, rng, **options)
                if shuffle:
                    others = rng.permuted(np.tile(held, (trials, 1)), axis=1)
                else:
                    others = held[(np.arange(bars) + rng.integers(1, bars, trials)[:, None]) % bars]
                out.append((1 + int((earned(others, returns) >= earned(held[None], returns)).sum())) / (trials + 1))
            yield pd.DataFrame({"id": batch.id, "p": out})

    found = spark.range(experiments).mapInPandas(run, "id long, p double")
    middle = F.element_at(F.array_sort(F.collect_list("p")), experiments // 2 + 1)  # one number an experiment
    return found.agg(F.avg((F.col("p") < alpha).cast("double")).alias("power"), middle.alias("median_p"), F.count(F.lit(1)).alias("experiments"))
