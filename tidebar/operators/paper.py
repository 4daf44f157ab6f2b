"""A paper account that is moved bar by bar: one cash balance, a position a coin, sized anew at every bar.

An account is a sequence, so its bars are a group (or the state of a stream) of its own; accounts run in parallel. Of a
bar that is seen again nothing changes.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import as_of_strict


@dataclass(frozen=True)
class Config:
    equity: float = 1000.0
    leverage: float = 1.0
    cost_bps: float = 4.5
    funding_per_hour: float = 0.0
    max_coins: int = 1
    max_leverage: float = 10.0


def new_account(c: Config) -> dict:
    """The state: cash, and for each coin the position, notional, last time, last price and buy-and-hold value."""
    return {"cash": c.equity, "dead": False, "coins": {}}


def on_bar(state: dict, c: Config, coin: str, time: int, high: float, low: float, close: float, target: float) -> dict | None:
    """Apply one bar: mark, liquidate, record, then trade. Gives the record of the bar, or None where it changes nothing."""
    own = state["coins"].setdefault(coin, {"position": 0.0, "notional": 0.0, "time": None, "price": None, "hold": None})
    if state["dead"] or (own["time"] is not None and time <= own["time"]):
        return None
    fee = funding = 0.0
    sign = (own["position"] > 0) - (own["position"] < 0)
    last = own["price"]
    moved = close / last if last else 1.0
    reason = ""
    if sign and last:
        funding = sign * own["notional"] * c.funding_per_hour * (time - own["time"]) / 3600
        worst = sign * own["notional"] * ((low if sign > 0 else high) / last - 1)
        if state["cash"] + worst - funding <= own["notional"] / (2 * c.max_leverage):
            state["dead"], state["cash"], reason = True, 0.0, "liquidation"
            fee = own["notional"] * c.cost_bps * 1e-4
            own["position"] = own["notional"] = 0.0
        else:
            state["cash"] += sign * own["notional"] * (moved - 1) - funding
    own["hold"] = c.equity / c.max_coins if own["hold"] is None else own["hold"] * moved
    own["time"], own["price"] = time, close
    equity = state["cash"]
    idle = c.equity * max(c.max_coins - sum(x["hold"] is not None for x in state["coins"].values()), 0) / c.max_coins
    hold = idle + sum(x["hold"] or 0.0 for x in state["coins"].values())
    if not state["dead"]:
        want, before = max(-1.0, min(1.0, target)), own["position"]
        share = equity / c.max_coins * c.leverage
        if abs(want - before) > 1e-12:
            fee = abs(want - before) * share * c.cost_bps * 1e-4
            state["cash"] -= fee
            reason = "exit" if want == 0 else "flip" if before * want < 0 else "entry"
        own["position"], own["notional"] = want, abs(want) * share
    return {"coin": coin, "time": time, "equity": equity, "buy_hold": hold, "position": own["position"], "fee": fee, "funding": funding, "reason": reason}


RECORD = "account string, coin string, time long, equity double, buy_hold double, position double, fee double, funding double, reason string"
_NAMES = [f.split()[0] for f in RECORD.split(", ")]


def records(state: dict, c: Config, account: str, rows: pd.DataFrame) -> pd.DataFrame:
    """The records of an account's bars in the order of (time, coin)."""
    out = []
    for r in rows.sort_values(["time", "coin"]).itertuples():
        done = on_bar(state, c, r.coin, int(r.time), r.high, r.low, r.close, r.target)
        if done:
            out.append({"account": account, **done})
    return pd.DataFrame(out, columns=_NAMES)


def replay(targets: DataFrame, config: Config = Config()) -> DataFrame:
    """Records of all accounts; ``targets`` has account, coin, time, high, low, close and target."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return records(new_account(config), config, rows["account"].iloc[0], rows)

    return targets.groupBy("account").applyInPandas(run, RECORD)


def marked(log: DataFrame, ticks: DataFrame, seconds: int, config: Config = Config()) -> DataFrame:
    """Equity of each account at ticks between bars: what is settled, plus what open positions have moved since their bar.

    ``log``: records with close, the price they were marked at; ``ticks``: series (the coin), time_ms, seq and price. A tick
    counts after the bar that ended before it, so nothing is traded and no record is made. Accounts of one coin.
    """
    settled = log.select(
        F.col("coin").alias("series"), "account", ((F.col("time") + seconds) * 1000 - 1).alias("time_ms"), (F.col("equity") - F.col("fee")).alias("cash"),
        (F.signum("position") * F.abs("position") * F.col("equity") / config.max_coins * config.leverage).alias("notional"), "close",
    )
    own = ticks.join(log.select(F.col("coin").alias("series"), "account").distinct(), "series")
    own = own.select(F.col("account").alias("series"), F.col("series").alias("coin"), "time_ms", "seq", "price")
    points = settled.select(F.col("account").alias("series"), "time_ms", "cash", "notional", "close")
    found = as_of_strict(own, points, "time_ms", ("cash", "notional", "close")).where("cash is not null")
    equity = F.col("cash") + F.col("notional") * (F.col("price") / F.col("close") - 1)
    return found.select(F.col("series").alias("account"), "coin", "time_ms", "seq", "price", equity.alias("equity"))


def statistics(log: DataFrame, config: Config = Config()) -> DataFrame:
    """Return, Sharpe at the curve's own pace, drawdown, round trips, their share that won, exposure and fees of each account.

    A record is a point of the curve, worth what was held through its bar; what is left at the end has paid the last order, too. A
    round trip goes from the order that opens a coin to the one that leaves it flat, and has won if the account was worth more
    then. A point is exposed if a coin was open after the orders of its time. The pace is the upper median of steps between points.
    """
    by = Window.partitionBy("account").orderBy("time", "coin")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    mine = Window.partitionBy("account", "coin").orderBy("time")
    until = Window.partitionBy("account").orderBy("time").rangeBetween(Window.unboundedPreceding, 0)
    at = Window.partitionBy("account", "time").orderBy("coin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    side = F.when(F.col("reason").isin("entry", "flip"), 1).when(F.col("reason").isin("exit", "liquidation"), 0)
    rows = log.withColumns(
        {
            "before": F.lag("equity").over(by), "gap": F.col("time") - F.lag("time").over(by), "peak": F.max("equity").over(upto),
            "worth": F.last("equity").over(at), "open": F.coalesce(F.last(side, True).over(mine.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)),
        }
    )
    rows = rows.withColumn("was", F.coalesce(F.lag("open").over(mine), F.lit(0)))
    rows = rows.withColumn("start", F.last(F.when((F.col("open") == 1) & (F.col("was") == 0), F.col("worth")), True).over(mine.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("held", F.sum(F.col("open") - F.col("was")).over(until))
    rows = rows.withColumn("r", F.when(F.col("before") > 0, F.log(F.greatest(F.col("equity") / F.nullif("before", F.lit(0.0)), F.lit(1e-9)))))
    closed = (F.col("open") == 0) & (F.col("was") == 1)
    left = F.when(F.col("reason") == "liquidation", 0.0).otherwise(F.col("equity") - F.col("fee"))
    order = F.struct("time", "coin")
    stats = rows.groupBy("account").agg(
        F.max_by(left, order).alias("final"), F.max_by("buy_hold", order).alias("hold"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"),
        F.max(F.when(F.col("peak") > 0, 1 - F.col("equity") / F.col("peak"))).alias("dd"), F.count_if(closed).alias("round_trips"),
        F.count_if(closed & (F.col("worth") > F.col("start"))).alias("wins"), F.avg((F.col("held") > 0).cast("double")).alias("exposure"), F.sum("fee").alias("fees"),
    )
    # the upper median from a table of counts, as there are few different steps
    gaps = rows.where("gap is not null").groupBy("account", "gap").agg(F.count(F.lit(1)).alias("c"))
    upper = gaps.withColumns({"upto": F.sum("c").over(Window.partitionBy("account").orderBy("gap")), "steps": F.sum("c").over(Window.partitionBy("account"))})
    pace = upper.where((F.col("upto") > F.floor(F.col("steps") / 2)) & (F.col("steps") > 1)).groupBy("account").agg(F.min("gap").alias("gap"))
    year = 365.25 * 86400
    sharpe = F.when((F.col("s") > 0) & (F.col("gap") > 0), F.col("m") / F.nullif("s", F.lit(0.0)) * F.sqrt(F.lit(year) / F.nullif("gap", F.lit(0)))).otherwise(0.0)
    roi = F.col("final") / config.equity - 1
    return stats.join(pace, "account", "left").select(
        "account", roi.alias("roi"), sharpe.alias("sharpe"), F.coalesce(F.greatest("dd", F.lit(0.0)), F.lit(0.0)).alias("max_drawdown"), "round_trips",
        F.coalesce(F.col("wins") / F.nullif("round_trips", F.lit(0)), F.lit(0.0)).alias("win_rate"), "exposure",
        (F.col("fees") / config.equity).alias("fee_drag"), (roi - (F.col("hold") / config.equity - 1)).alias("over_buy_hold"),
    )
