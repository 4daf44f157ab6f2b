"""What the registered queries share: the bindings to the tables and the same pieces as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import features as X
from ..sources import tape

HOUR = 3600


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tumbling(tape.event_ticks(spark, sf_dir), HOUR)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tumbling(tape.order_ticks(spark, sf_dir), 86400)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.price_features(hourly(spark, sf_dir))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A print for each hourly bar, 26 ms after its open: rate and premium from its prices."""
    return hourly(spark, sf_dir).select(
        "series",
        "time",
        (F.col("time") * 1000 + 26).alias("time_ms"),
        (F.col("close") * 1e-6).alias("rate"),
        ((F.col("close") - F.col("open")) * 1e-6).alias("premium"),
    )


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros, so that sums in another order compare equal."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def r(expression: str, name: str | None = None, places: int = 6) -> str:
    return f"round({expression}, {places}) + CAST(0 AS DOUBLE) AS {name or expression}"


def rs(*names: str, places: int = 6) -> str:
    return ", ".join(r(n, places=places) for n in names)


TICKS = """ticks AS (
  SELECT event_type AS series, epoch_us(ts) // 1000 AS time_ms, CAST(floor(epoch(ts)) AS BIGINT) AS time, event_id AS seq,
         value AS price, value AS volume FROM events)"""

ORDER_TICKS = """order_ticks AS (
  SELECT o_orderpriority AS series, epoch_ms(o_orderdate) AS time_ms, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS time,
         o_orderkey AS seq, o_totalprice AS price, CAST(1 AS DOUBLE) AS volume FROM orders)"""


def bars_sql(seconds: int = HOUR, name: str = "bars", ticks: str = "ticks") -> str:
    return f"""{name} AS (
  SELECT series, (time // {seconds}) * {seconds} AS time, arg_min(price, (time_ms, seq)) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, (time_ms, seq)) AS close, sum(volume) AS volume, count(*) AS trades
  FROM {ticks} GROUP BY ALL)"""


BARS = f"{TICKS},\n{bars_sql()}"
DAILY = f"{ORDER_TICKS},\n{bars_sql(86400, 'daily', 'order_ticks')}"

FEATURES = f"""{BARS},
returns AS (
  SELECT *, row_number() OVER w - 1 AS idx,
         coalesce(ln(greatest(close, 1e-18) / greatest(lag(close) OVER w, 1e-18)), CAST(0 AS DOUBLE)) AS log_return,
         count(*) OVER (PARTITION BY series) AS n
  FROM bars WINDOW w AS (PARTITION BY series ORDER BY time)),
features AS (
  SELECT series, idx - 5 AS row, idx, time, close, log_return, realized_vol, volume_surge
  FROM (SELECT *, ln(stddev_pop(log_return) OVER w + 1e-8) AS realized_vol,
               ln((greatest(volume, 0) + 1e-8) / (avg(greatest(volume, 0)) OVER w + 1e-8)) AS volume_surge
        FROM returns
        WINDOW w AS (PARTITION BY series ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  WHERE idx >= 5 AND n >= 7)"""

PRINTS = f"""{BARS},
prints AS (
  SELECT series, time, time * 1000 + 26 AS time_ms, close * 1e-6 AS rate, (close - open) * 1e-6 AS premium FROM bars)"""
