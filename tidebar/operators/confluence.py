"""Agreement of three timeframes: a bias, a setup and a trigger vote on each base bar."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import automaton
from .align import completed_bar
from .bars import by_time

ROLES = ("bias", "setup", "trigger")


@dataclass(frozen=True)
class Rule:
    gate_bps: float = 0.0
    trigger_bps: float = 0.0
    bias_confidence: float = 0.0
    exit_on_bias_flip: bool = True
    allow_short: bool = False


def stack(base: DataFrame, higher: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Base bars (series, time) with expected, bull and bear of each role, seen only once the role's bar has ended.

    ``higher`` has for each role its forecasts on its own bars and its number of base bars.
    """
    out = base.select("series", "time")
    for role in ROLES:
        forecasts, factor = higher[role]
        seen = completed_bar(base.select("series", "time"), forecasts, factor, ["expected", "bull", "bear"])
        names = {f"higher_{c}": f"{role}_{c}" for c in ("expected", "bull", "bear")}
        out = out.join(seen.select("series", "time", *(F.col(a).alias(b) for a, b in names.items())), ["series", "time"])
    return out


def votes(rows: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Adds ready, bulls, bears, agreement (-3 .. 3), bias_long and bias_short."""
    gates = {"bias": rule.gate_bps * 1e-4, "setup": rule.gate_bps * 1e-4, "trigger": rule.trigger_bps * 1e-4}
    count = lambda up: sum(((F.col(f"{x}_expected") > g) if up else (F.col(f"{x}_expected") < -g)).cast("int") for x, g in gates.items())
    ready = F.col("bias_expected").isNotNull() & F.col("setup_expected").isNotNull() & F.col("trigger_expected").isNotNull()
    gate = gates["bias"]
    rows = rows.withColumns({"ready": ready, "bulls": F.coalesce(count(True), F.lit(0)), "bears": F.coalesce(count(False), F.lit(0))})
    return rows.withColumns(
        {
            "agreement": F.when(F.col("ready"), F.col("bulls") - F.col("bears")).otherwise(0),
            "bias_long": F.col("ready") & (F.col("bias_expected") > gate) & (F.col("bias_bull") >= rule.bias_confidence),
            "bias_short": F.col("ready") & (F.col("bias_expected") < -gate) & (F.col("bias_bear") >= rule.bias_confidence),
        }
    )


def combine(voted: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Adds position. All three must agree to enter; one broken gate is enough to leave."""
    if rule.allow_short:
        return _combine_both(voted, rule)
    gone = ~F.col("bias_long") if rule.exit_on_bias_flip else F.col("bulls") == 0
    event = F.when(~F.col("ready"), 0.0).when(F.col("bias_long") & (F.col("bulls") == 3), 1.0).when(gone, 0.0)
    w = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return voted.withColumn("position", F.coalesce(F.last(event, True).over(w), F.lit(0.0)))


def _combine_both(voted: DataFrame, rule: Rule) -> DataFrame:
    """With shorts a flip passes through a flat bar, which no single window expression says: each bar is a map of the side held."""

    def maps(rows: pd.DataFrame) -> np.ndarray:
        ready, up, down = (rows[c].to_numpy(bool) for c in ("ready", "bias_long", "bias_short"))
        bulls, bears = rows["bulls"].to_numpy(int), rows["bears"].to_numpy(int)
        stay_long, stay_short = (up, down) if rule.exit_on_bias_flip else (bulls != 0, bears != 0)
        enter = np.where(up & (bulls == 3), 1, np.where(down & (bears == 3), -1, 0))
        return automaton.sided(np.where(ready & stay_short, -1, 0), np.where(ready, enter, 0), np.where(ready & stay_long, 1, 0))

    return automaton.walked(voted, "time", maps)
