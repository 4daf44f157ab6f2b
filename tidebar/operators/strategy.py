"""From forecasts to positions and accounts: decide on bar i, earn bar i + 1."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import automaton
from .bars import by_time

BPS = 1e-4


@dataclass(frozen=True)
class Strategy:
    """Costs are for one side; entry and exit thresholds in basis points of expected return."""

    cost_bps: float = 30.0
    entry_bps: float | None = None
    exit_bps: float = 0.0
    allow_short: bool = False
    vol_target: float = 0.0
    max_position: float = 1.0
    confidence: float = 0.0
    duration_aware: bool = False

    def thresholds(self, hold: float = 1.0) -> tuple[float, float]:
        if self.duration_aware:
            return 2 * self.cost_bps * BPS / max(hold, 1.0), 0.0
        return (2 * self.cost_bps if self.entry_bps is None else self.entry_bps) * BPS, self.exit_bps * BPS


def label_state(bps: Column) -> Column:
    """Names of regimes by mean return in basis points."""
    return F.when(bps > 20, "PUMP").when(bps > 3, "drift-up").when(bps < -20, "DUMP").when(bps < -3, "bleed").otherwise("chop")


def long_only(forecasts: DataFrame, entry: float, exit: float, *keys: str) -> DataFrame:
    """Adds position: in above ``entry``, out at or below ``exit``, else as before. Needs entry >= exit.

    Under that condition the last decisive row decides, so the automaton is one window expression.
    """
    if entry < exit:
        raise ValueError("the entry threshold must not be below the exit threshold; use decide() instead")
    event = F.when(F.col("expected") > entry, 1.0).when(F.col("expected") <= exit, 0.0)
    w = Window.partitionBy(*(keys or ("series",))).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return forecasts.withColumn("position", F.coalesce(F.last(event, True).over(w), F.lit(0.0)))


def decide(forecasts: DataFrame, strategy: Strategy, keys: tuple[str, ...] = ("series", "block")) -> DataFrame:
    """Adds position with shorts, volatility target and holding times: state within a test block, which is bounded.

    A flip passes through zero; rows are maps of the side held, which are composed without a loop (:mod:`.automaton`). ``forecasts`` has row, expected, and where used volatility, hold and top (probability
    of the best state).
    """
    names = forecasts.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        of = lambda c, other: rows[c].to_numpy(float) if c in names else np.full(len(rows), other)
        if strategy.confidence > 0:
            return rows.assign(position=(of("top", 0.0) > strategy.confidence).astype(float))
        x, vol = of("expected", 0.0), of("volatility", 0.0)
        enter, leave = strategy.thresholds(1.0)
        if strategy.duration_aware:  # NaN holds as one bar
            enter, leave = 2 * strategy.cost_bps * BPS / np.fmax(of("hold", 1.0), 1.0), 0.0
        short = np.where(x < -enter, -1, 0) if strategy.allow_short else 0
        maps = automaton.sided(np.where(x < -leave, -1, 0), np.where(x > enter, 1, short), np.where(x > leave, 1, 0))
        side = automaton.composed(maps)[:, automaton.FLAT] - 1.0
        if strategy.vol_target > 0:
            side = side * np.where(vol > 0, np.minimum(1.0, strategy.vol_target / np.where(vol > 0, vol, 1.0)), 1.0)
        return rows.assign(position=np.clip(side, -strategy.max_position, strategy.max_position) + 0.0)  # no negative zeros

    schema = ", ".join(f"`{n}` {t}" for n, t in forecasts.dtypes if n != "position") + ", position double"
    return forecasts.groupBy(*keys).applyInPandas(run, schema)


def next_position(plan: Strategy) -> Column:
    """The one step of :func:`decide` from previous, expected, hold, volatility and top."""
    expected, previous, hold = F.col("expected"), F.col("previous"), F.greatest("hold", F.lit(1.0))
    enter, leave = plan.thresholds()
    enter = 2 * plan.cost_bps * BPS / hold if plan.duration_aware else F.lit(enter)
    if plan.confidence > 0:
        return (F.col("top") > plan.confidence).cast("double")
    short = F.when(expected < -enter, -1.0).otherwise(0.0) if plan.allow_short else F.lit(0.0)
    side = (
        F.when(previous > 0, F.when(expected > leave, 1.0).otherwise(0.0))
        .when(previous < 0, F.when(expected < -leave, -1.0).otherwise(0.0))
        .otherwise(F.when(expected > enter, 1.0).otherwise(short))
    )
    if plan.vol_target > 0:
        side = side * F.when(F.col("volatility") > 0, F.least(F.lit(1.0), plan.vol_target / F.nullif("volatility", F.lit(0.0)))).otherwise(1.0)
    return F.greatest(F.lit(-plan.max_position), F.least(F.lit(plan.max_position), side)) + F.lit(0.0)


def traded(positions: DataFrame, first_row: int = 0) -> DataFrame:
    """Rows from ``first_row`` on that have a next bar, with ret, its simple return."""
    ahead = F.lead("log_return").over(by_time(order="row"))
    return positions.withColumn("ret", F.exp(ahead) - 1).where(F.col("ret").isNotNull() & (F.col("row") >= first_row))


def accounted(rows: DataFrame, cost_bps: float | Column, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Adds delta (change of position, from none), cost and net of each bar."""
    w = Window.partitionBy(*keys).orderBy("row")
    cost = F.lit(cost_bps) if isinstance(cost_bps, (int, float)) else cost_bps
    delta = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    out = rows.withColumn("delta", delta).withColumn("cost", F.col("delta") * cost * BPS)
    return out.withColumn("net", F.col("position") * F.col("ret") - F.col("cost"))


def compound(rows: DataFrame, cost_bps: float, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """total: what the positions earn, compounded, net of costs. A product, as a net return may be -1 or less."""
    return accounted(rows, cost_bps, keys).groupBy(*keys).agg((F.product(1 + F.col("net")) - 1).alias("total"))


def equity_curve(rows: DataFrame, cost_bps: float, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Adds equity, buy_hold, peak and drawdown, all from 1."""
    w = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    out = accounted(rows, cost_bps, keys)
    out = out.withColumn("equity", F.product(1 + F.col("net")).over(w)).withColumn("buy_hold", F.product(1 + F.col("ret")).over(w))
    out = out.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(1.0)))
    return out.withColumn("drawdown", 1 - F.col("equity") / F.col("peak"))


def metrics(rows: DataFrame, cost_bps: float, bars_per_year: float, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """One row of results for each key: returns, Sharpe of log returns, drawdown, hit rate, changes, turnover, exposure."""
    curve = equity_curve(rows, cost_bps, keys).withColumn("log_net", F.log(F.greatest(1 + F.col("net"), F.lit(1e-9))))
    held = F.abs("position") > 1e-9
    hits = F.count_if(held & (F.col("position") * F.col("ret") > 0))
    sd = F.stddev_samp("log_net")
    return curve.groupBy(*keys).agg(
        F.max_by("equity", "row").alias("_equity"),
        F.max_by("buy_hold", "row").alias("_hold"),
        F.when(sd > 0, F.avg("log_net") / F.nullif(sd, F.lit(0.0)) * bars_per_year**0.5).otherwise(0.0).alias("sharpe"),
        F.max("drawdown").alias("max_drawdown"),
        F.coalesce(hits / F.nullif(F.count_if(held), F.lit(0)), F.lit(0.0)).alias("hit_rate"),
        F.count_if(F.col("delta") > 1e-9).alias("position_changes"),
        F.sum("delta").alias("turnover"),
        (F.count_if(held) / F.count(F.lit(1))).alias("exposure"),
        F.count(F.lit(1)).alias("bars"),
        F.sum("cost").alias("cost_drag"),
    ).withColumns({"total_return": F.col("_equity") - 1, "buy_hold_return": F.col("_hold") - 1}).drop("_equity", "_hold")


def cost_sweep(forecasts: DataFrame, levels: tuple[float, ...] = (0, 5, 10, 20, 30, 50)) -> DataFrame:
    """Total return at each cost, with twice the cost to enter; forecasts are made once and shared by all levels."""
    level = forecasts.withColumn("cost_bps", F.explode(F.array(*(F.lit(float(c)) for c in levels))))
    event = F.when(F.col("expected") > 2 * F.col("cost_bps") * BPS, 1.0).when(F.col("expected") <= 0, 0.0)
    keys = ("series", "cost_bps")
    w = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.lead("log_return").over(Window.partitionBy(*keys).orderBy("row"))
    rows = level.withColumn("position", F.coalesce(F.last(event, True).over(w), F.lit(0.0))).withColumn("ret", F.exp(ahead) - 1)
    done = accounted(rows.where("ret is not null"), F.col("cost_bps"), keys)
    return done.groupBy(*keys).agg((F.product(1 + F.col("net")) - 1).alias("total_return"), F.count_if(F.col("delta") > 1e-9).alias("position_changes"))
