"""Round trips of a position series: gaps and islands on its sign, then grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import price_at
from .bars import by_time

BPS = 1e-4
WINDOWS = {"24h": 86400, "5d": 5 * 86400, "1w": 7 * 86400, "2w": 14 * 86400}


def direction():
    return F.when(F.col("position") > 1e-9, 1).when(F.col("position") < -1e-9, -1).otherwise(0)


def runs(rows: DataFrame, first_row: int = 0) -> DataFrame:
    """Rows that have a next bar, with dir, ret, next_time, next_close and run: a number for each stretch of one sign."""
    w = by_time(order="row")
    rows = rows.withColumns(
        {
            "dir": direction(),
            "ret": F.exp(F.lead("log_return").over(w)) - 1,
            "next_time": F.lead("time").over(w),
            "next_close": F.lead("close").over(w),
        }
    ).where(F.col("ret").isNotNull() & (F.col("row") >= first_row))
    changed = F.coalesce(F.col("dir") != F.lag("dir").over(w), F.lit(True)).cast("int")
    return rows.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w)).drop("_new")


def trades(rows: DataFrame, cost_bps: float, first_row: int = 0) -> DataFrame:
    """One row a round trip; it earns its direction, whatever its size, and pays both sides. An open one ends at the end."""
    side = 1 - cost_bps * BPS
    found = runs(rows, first_row).where("dir <> 0").groupBy("series", "run").agg(
        F.min("row").alias("entry_row"),
        F.min("time").alias("entry_time"),
        F.max("next_time").alias("exit_time"),
        F.max("dir").alias("direction"),
        F.count(F.lit(1)).alias("bars_held"),
        F.min_by("close", "row").alias("entry_price"),
        F.max_by("next_close", "row").alias("exit_price"),
        (F.product(1 + F.col("dir") * F.col("ret")) - 1).alias("gross_return"),
    )
    found = found.withColumn("exit_row", F.col("entry_row") + F.col("bars_held"))
    found = found.withColumn("cost_paid", F.lit(2 * cost_bps * BPS)).withColumn("net_return", (1 + F.col("gross_return")) * side * side - 1)
    return found.withColumn("win", F.col("net_return") > 0).drop("run")


def summarize(ledger: DataFrame, *keys: str) -> DataFrame:
    """Counts, returns and the profit factor (null where nothing was lost) of the trades of each key."""
    won, lost = F.col("net_return") > 0, F.col("net_return") <= 0
    gains = F.sum(F.when(won, F.col("net_return")))
    losses = F.abs(F.sum(F.when(lost, F.col("net_return"))))
    zero = F.lit(0.0)
    return ledger.groupBy(*(keys or ("series",))).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(won).alias("wins"),
        (F.count_if(won) / F.count(F.lit(1))).alias("win_rate"),
        (F.product(1 + F.col("net_return")) - 1).alias("roi"),
        F.coalesce(gains / F.nullif(F.count_if(won), F.lit(0)), zero).alias("avg_win"),
        F.coalesce(-losses / F.nullif(F.count_if(lost), F.lit(0)), zero).alias("avg_loss"),
        F.max("net_return").alias("best_trade"),
        F.min("net_return").alias("worst_trade"),
        F.avg("bars_held").alias("avg_bars_held"),
        (F.coalesce(gains, zero) / F.nullif(losses, zero)).alias("profit_factor"),
    )


def window_report(ledger: DataFrame, bars: DataFrame) -> DataFrame:
    """Trades by entry time in spans back from each series' last bar, beside buying at their start and holding."""
    last = bars.groupBy("series").agg(F.max("time").alias("last_time"), F.max_by("close", "time").alias("last_close"))
    spans = F.explode(F.array(*(F.struct(F.lit(n).alias("span"), F.lit(s).alias("seconds")) for n, s in WINDOWS.items())))
    grid = last.select("*", spans.alias("w")).select("series", "last_close", "w.span", (F.col("last_time") - F.col("w.seconds")).alias("at"))
    start = price_at(bars, grid.select("series", "at"))
    grid = grid.join(start, ["series", "at"])
    own = ledger.select("series", "entry_time", "net_return").alias("t")
    inside = grid.alias("g").join(own, (F.col("g.series") == F.col("t.series")) & (F.col("t.entry_time") >= F.col("g.at")), "left")
    return inside.groupBy("g.series", "span", "price", "last_close").agg(
        F.count("net_return").alias("trades"),
        F.count_if(F.col("net_return") > 0).alias("wins"),
        F.coalesce(F.product(1 + F.col("net_return")) - 1, F.lit(0.0)).alias("roi"),
    ).select("series", "span", "trades", "wins", "roi", (F.col("last_close") / F.nullif("price", F.lit(0.0)) - 1).alias("buy_hold"))


def rank_within(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The best row of each key by ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
