"""Ticks of the tables that serve as tapes: series, time (epoch seconds), seq (a tie-break), price, volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each event type; the value is both price and volume."""
    return read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.col("value").alias("volume"),
    )


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each order priority; the total price is price, each order is one unit of volume."""
    stamp = F.col("o_orderdate").cast("timestamp")
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series"),
        F.unix_millis(stamp).alias("time_ms"),
        F.unix_seconds(stamp).alias("time"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("volume"),
    )
