"""Information coefficients: linear and rank correlation of features with the next return, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pearson(x: str, y: str, least: int = 3) -> Column:
    """Correlation over the rows of a group, null for fewer than ``least`` rows or a constant side."""
    apart = F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0) & (F.count(F.lit(1)) >= least), F.lit(1))
    return F.when(apart.isNotNull(), F.covar_pop(x, y) / F.sqrt(F.var_pop(x) * F.var_pop(y)))


def mid_rank(value: str, *keys: str) -> Column:
    """Rank from 1 within the keys, ties share the mean of theirs."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def valid_pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))


def t_stat(ic: Column, n: Column) -> Column:
    return F.when(n > 3, ic * F.sqrt(n - 2) / F.sqrt(F.greatest(1 - ic * ic, F.lit(1e-12))))


def measure_ic(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """n, pearson, spearman and t of each feature in each series: all rows, and the first and second half of them.

    Features become rows, so that every feature and every part is one grouped aggregate.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("series"))
    place = F.row_number().over(Window.partitionBy("series").orderBy("row")) - 1
    marked = rows.withColumn("half", F.when(place < F.floor(size / 2), "first").otherwise("second"))
    long = marked.unpivot(["series", "row", "half", target], features, "feature", "value")
    long = valid_pairs(long, "value", target)
    parts = long.withColumn("part", F.explode(F.array(F.lit("all"), F.col("half"))))
    keys = ("series", "feature", "part")
    parts = parts.withColumn("rx", mid_rank("value", *keys)).withColumn("ry", mid_rank(target, *keys))
    stats = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("value", target).alias("pearson"), pearson("rx", "ry").alias("spearman"))
    return stats.withColumn("t", t_stat(F.col("spearman"), F.col("n")))
