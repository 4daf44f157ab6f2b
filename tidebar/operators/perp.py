"""A leveraged account with fees, funding and liquidation, as products over round trips.

The size of a trade is proportional to the equity at its entry, so what it makes of the equity is a factor that does not
depend on it: the account is a running product of factors, cut at the first liquidation or the first order that would be
too small. No loop over bars is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import by_time
from .trades import runs


@dataclass(frozen=True)
class Perp:
    equity: float = 50.0
    leverage: float = 2.0
    taker_bps: float = 4.5
    maintenance: float = 0.05
    min_order: float = 10.0


def maintenance_fraction(max_leverage: Column) -> Column:
    """Half the margin at the greatest leverage, 0.05 where that is not known."""
    return F.coalesce(1 / (2 * F.nullif(max_leverage, F.lit(0.0))), F.lit(0.05))


def _rows(positions: DataFrame, funding: DataFrame) -> DataFrame:
    """Held rows with what the account needs: ``positions`` has high and low; ``funding`` has series, time, total."""
    w = by_time(order="row")
    ahead = positions.withColumns({"next_high": F.lead("high").over(w), "next_low": F.lead("low").over(w)})
    rows = runs(ahead).join(funding.select("series", "time", F.col("total").alias("funding")), ["series", "time"], "left")
    own = Window.partitionBy("series", "run").orderBy("row")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns(
        {"entry_price": F.first("close").over(own), "carried": F.sum(F.coalesce("funding", F.lit(0.0))).over(so_far)}
    )


def trade_factors(positions: DataFrame, funding: DataFrame, perp: Perp) -> DataFrame:
    """For each round trip what it makes of one unit of equity: gross, fees, funding, factor, and whether it is liquidated."""
    fee, lev = perp.taker_bps * 1e-4, perp.leverage
    rows = _rows(positions, funding).where("dir <> 0")
    adverse = F.when(F.col("dir") > 0, F.col("next_low")).otherwise(F.col("next_high"))
    worst = 1 + lev * (F.col("dir") * (adverse / F.col("entry_price") - 1) - fee - F.col("dir") * F.col("carried"))
    rows = rows.withColumn("adverse", adverse).withColumn("broken", worst <= lev * perp.maintenance)
    cut = F.min(F.when(F.col("broken"), F.col("row"))).over(Window.partitionBy("series", "run"))
    rows = rows.withColumn("cut", cut).where("cut is null or row <= cut")
    ends = F.when(F.max("cut").isNotNull(), F.max_by("adverse", "row")).otherwise(F.max_by("next_close", "row"))
    found = rows.groupBy("series", "run").agg(
        F.min("row").alias("entry_row"), (F.max("row") + 1).alias("exit_row"), F.max("dir").alias("direction"),
        F.max("entry_price").alias("entry_price"), ends.alias("exit_price"), F.max_by("carried", "row").alias("carried"),
        F.max("cut").isNotNull().alias("liquidated"),
    )
    ratio = F.col("exit_price") / F.col("entry_price")
    found = found.withColumns(
        {
            "gross": lev * F.col("direction") * (ratio - 1),
            "fees": lev * fee * (1 + ratio),
            "paid_funding": lev * F.col("direction") * F.col("carried"),
        }
    )
    factor = F.greatest(1 + F.col("gross") - F.col("fees") - F.col("paid_funding"), F.lit(0.0))
    return found.withColumn("factor", F.when(F.col("liquidated"), 0.0).otherwise(factor))


def account(positions: DataFrame, funding: DataFrame, perp: Perp) -> DataFrame:
    """The ledger in money: notional, gross, fees, funding, net and equity after each trade that is made."""
    found = trade_factors(positions, funding, perp)
    w = Window.partitionBy("series").orderBy("entry_row")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("equity_before", perp.equity * F.coalesce(F.product("factor").over(before), F.lit(1.0)))
    stop = (F.col("equity_before") * perp.leverage < perp.min_order) | (F.col("equity_before") <= 0)
    stopped = F.max(stop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    made = found.withColumn("_stopped", stopped).where("_stopped = 0")
    unit = F.col("equity_before")
    return made.select(
        "series", "entry_row", "exit_row", "direction", "entry_price", "exit_price", "liquidated",
        (unit * perp.leverage).alias("notional"), (unit * F.col("gross")).alias("gross_pnl"), (unit * F.col("fees")).alias("fees"),
        (unit * F.col("paid_funding")).alias("funding"),
        (unit * (F.col("gross") - F.col("fees") - F.col("paid_funding"))).alias("net_pnl"), (unit * F.col("factor")).alias("equity_after"),
    )


def account_summary(ledger: DataFrame, perp: Perp) -> DataFrame:
    return ledger.groupBy("series").agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(F.col("net_pnl") > 0).alias("wins"),
        F.max_by("equity_after", "entry_row").alias("final_equity"),
        F.sum("fees").alias("total_fees"),
        F.sum("funding").alias("total_funding"),
        F.max("liquidated").alias("liquidated"),
        F.sum(F.col("exit_row") - F.col("entry_row")).alias("bars_in_market"),
    )
