"""Live forms: bars of a stream of ticks, and paper accounts kept as state.

A bar leaves the stream once the watermark has passed its end, so only closed bars are ever acted on. The state of the
bar stream is one row a series and open bar; that of an account is its cash and positions; that of a belief is the
filter of its model, so a bar costs the same however long the series has run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..models import chain, jump, semi
from ..models.grouped import from_row
from ..operators.paper import RECORD, Config, new_account, records


def live_bars(ticks: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Closed bars of a stream with series, ts (timestamp), seq, price and volume."""
    at = F.struct("ts", "seq")
    bars = (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{seconds} seconds"), "series")
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("trades"),
        )
    )
    return bars.select("series", F.unix_seconds("window.start").alias("time"), "open", "high", "low", "close", "volume", "trades")


def live_accounts(targets: DataFrame, config: Config = Config()) -> DataFrame:
    """Records of paper accounts from a stream with account, coin, time, high, low, close and target."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else new_account(config)
        rows = pd.concat(list(batches))  # the bars of one account in one trigger
        out = records(own, config, key[0], rows)
        state.update((json.dumps(own),))
        yield out

    return targets.groupBy("account").applyInPandasWithState(run, RECORD, "account_state string", "append", GroupStateTimeout.NoTimeout)


def live_signal(bars: DataFrame, expected, entry: float, cost_bps: float) -> DataFrame:
    """target of each closed bar: in where the expected return clears the entry threshold and both sides' cost."""
    bar = max(entry, 2 * cost_bps * 1e-4)
    return bars.withColumn("target", F.when(expected > bar, 1.0).otherwise(0.0))


_BELIEF = "series string, time long, state int, now array<double>, ahead array<double>"


def live_beliefs(rows: DataFrame, models: DataFrame, names: list[str], kind: str = "hmm", price: float = 1.0) -> DataFrame:
    """Filtered beliefs of each bar and of the next, as the batch filter has them, from a stream with series, time and features.

    ``models``: a saved table of :func:`fit_models`, one row a series, joined to the bars, so that only the models of a batch's
    series travel. Bars must come in order of time from trigger to trigger; one that is not later than the last one changes
    nothing and gives no row; nor does one of a series without a model.
    """
    parts = ("states", "pi", "a", "mu", "var", "nu", "dur")
    own = models.where("skipped is null").select("series", *(F.col(c).alias(f"_{c}") for c in parts))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(batches)).sort_values("time")
        m = from_row({c: given[f"_{c}"].iloc[0] for c in parts}, len(names))
        last, held = (state.get[0], np.array(state.get[1])) if state.exists else (None, None)
        out = []
        for at, x in zip(given["time"].tolist(), given[names].to_numpy(float)):
            if last is not None and at <= last:
                continue
            if kind == "jump":
                held, now, ahead = jump.belief_step(m, x, held, price)
            else:
                held, now, ahead = (semi if m.dur is not None else chain).belief_step(m, x, held)
            last = at
            out.append((key[0], at, int(now.argmax()), now.tolist(), ahead.tolist()))
        if out:
            state.update((int(last), held.tolist()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _BELIEF.split(", ")])

    joined = rows.select("series", "time", *names).join(own, "series")
    return joined.groupBy("series").applyInPandasWithState(run, _BELIEF, "last long, filter array<double>", "append", GroupStateTimeout.NoTimeout)


def live_marks(ticks: DataFrame, held: DataFrame) -> DataFrame:
    """What open positions have moved at each tick since their last bar: nothing is traded and no curve gets a point.

    ``ticks``: a stream with series, ts and price; ``held``: a table with account, coin, notional (signed), price and cash.
    """
    own = held.select("account", F.col("coin").alias("series"), "cash", "notional", F.col("price").alias("mark")).where("notional <> 0 and mark > 0")
    moved = F.col("notional") * (F.col("price") / F.col("mark") - 1)
    return ticks.where("price > 0").join(own, "series").select("account", F.col("series").alias("coin"), "ts", "price", moved.alias("unrealized"), (F.col("cash") + moved).alias("equity"))
