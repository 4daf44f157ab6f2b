"""What luck would have made of the same positions: rotations, oracles and pooled panels.

Rotation keeps every run, and so the turnover; a rotation common to all series also keeps the market. Shifts are a table
(trial, shift), so that a result can be checked; what all shifts earn comes from :mod:`.rotation`, and a trial asks for one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rotation import panel_rotations, rotations

BPS = 1e-4


def shift_table(spark: SparkSession, trials: int, seed: int = 99) -> DataFrame:
    """trial and draw, a whole number that gives a shift from 1 to n - 1 as 1 + draw mod (n - 1). Shift 0 is never drawn."""
    return spark.range(trials).select(F.col("id").alias("trial"), (((F.col("id") + seed) * 7919 + 104_729) % 1_000_003).alias("draw"))


def _shift(n: Column) -> Column:
    return 1 + F.col("draw") % F.greatest(n - 1, F.lit(1))


def _nets(rows: DataFrame, keys: list[str], cost_bps: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("i")
    turn = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    return rows.withColumn("net", F.col("position") * F.col("ret") - turn * cost_bps * BPS)


def at_quantile(values: str, fraction: float) -> Column:
    """The value at floor(fraction * (n - 1)) of a sorted list of trials."""
    return F.element_at(values, (F.floor(fraction * (F.size(values) - 1)) + 1).cast("int"))


def shuffled_place() -> Column:
    """A repeatable order of the places i of a trial."""
    mixed = (F.col("trial") + 1) * 7919 + F.col("i") * 104_729 + 13
    return (mixed * 48_271 % 2_147_483_647) * 16_807 % 2_147_483_647


def rotation_null(rows: DataFrame, shifts: DataFrame, cost_bps: float, method: str = "rotate") -> DataFrame:
    """``rows``: series, row, position, ret. Actual return, quantiles over the trials, and the share that does as well.

    ``method``: ``rotate``, or ``shuffle``, a free order of the positions, which only suits positions that cost nothing to change.
    """
    if method == "rotate":  # all rotations are known at once; the trials are some of them
        draws = shifts.agg(F.collect_list("draw").alias("asked"))  # one number a trial
        n = F.size("totals")
        at = lambda d: F.element_at("totals", ((1 + d % F.greatest(n - 1, F.lit(1))) % n + 1).cast("int"))
        found = rotations(rows, cost_bps).join(F.broadcast(draws)).withColumn("actual", F.col("totals")[0])
        found = found.select("series", "actual", "exposure", F.array_sort(F.transform("asked", at)).alias("draws"))
        near = F.col("actual") - 1e-12 * (1 + F.abs("actual"))
        lists = found.withColumns({"beat": F.size(F.filter("draws", lambda d: d >= near)), "trials": F.size("draws").cast("long")})
    else:
        lists = _shuffles(rows, shifts, cost_bps)
    return lists.select(
        "series", "actual", "exposure", at_quantile("draws", 0.5).alias("median_random"), at_quantile("draws", 0.05).alias("p05"),
        at_quantile("draws", 0.95).alias("p95"), (F.col("beat") / F.col("trials")).alias("p_value"), "trials",
    )


def _shuffles(rows: DataFrame, shifts: DataFrame, cost_bps: float) -> DataFrame:
    """The draws of free orders of the positions, beside the actual return."""
    place = Window.partitionBy("series").orderBy("row")
    own = rows.withColumn("i", F.row_number().over(place) - 1)
    held = F.avg((F.abs("position") > 1e-9).cast("double"))
    actual = _nets(own, ["series"], cost_bps).groupBy("series").agg((F.product(1 + F.col("net")) - 1).alias("actual"), held.alias("exposure"))
    asked = own.select("series", "i", "ret").join(F.broadcast(shifts))
    asked = asked.withColumn("j", F.row_number().over(Window.partitionBy("series", "trial").orderBy(shuffled_place(), "i")) - 1)
    turned = asked.join(own.select("series", F.col("i").alias("j"), "position"), ["series", "j"])
    drawn = _nets(turned, ["series", "trial"], cost_bps).groupBy("series", "trial").agg((F.product(1 + F.col("net")) - 1).alias("total"))
    return drawn.join(actual, "series").groupBy("series", "actual", "exposure").agg(
        F.array_sort(F.collect_list("total")).alias("draws"),  # one value a trial
        F.count_if(F.col("total") >= F.col("actual")).alias("beat"),
        F.count(F.lit(1)).alias("trials"),
    )


def permutation_test(rows: DataFrame, shifts: DataFrame, cost_bps: float) -> DataFrame:
    """Free shuffles where positions cost nothing to change; rotations, which keep the turnover, where they do."""
    return rotation_null(rows, shifts, cost_bps, "rotate" if cost_bps > 0 else "shuffle")


def ceiling(rows: DataFrame, holds: tuple[int, ...] = (1, 5, 20), costs: tuple[float, ...] = (0, 10, 30, 50)) -> DataFrame:
    """What perfect foresight earns that is held ``hold`` bars at a time: long where a block of bars goes up."""
    place = Window.partitionBy("series").orderBy("row")
    own = rows.select("series", (F.row_number().over(place) - 1).alias("i"), "ret")
    own = own.withColumn("hold", F.explode(F.array(*map(F.lit, holds))))
    block = Window.partitionBy("series", "hold", F.floor(F.col("i") / F.col("hold")))
    own = own.withColumn("position", (F.product(1 + F.col("ret")).over(block) > 1).cast("double"))
    w = Window.partitionBy("series", "hold").orderBy("i")
    own = own.withColumn("turn", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    own = own.withColumn("cost_bps", F.explode(F.array(*(F.lit(float(c)) for c in costs))))
    return own.groupBy("series", "hold", "cost_bps").agg(
        (F.product(1 + F.col("position") * F.col("ret") - F.col("turn") * F.col("cost_bps") * BPS) - 1).alias("roi"),
        F.count_if(F.col("turn") > 1e-9).alias("position_changes"),
        F.avg("position").alias("exposure"),
        (F.product(1 + F.col("ret")) - 1).alias("buy_hold"),
        F.count(F.lit(1)).alias("bars"),
    )


def _pooled(rows: DataFrame, keys: list[str], cost_bps: float) -> DataFrame:
    """Adds net in basis points, null where a side is missing; the position before is the last one that is not null."""
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last("position", True).over(w), F.lit(0.0))
    return rows.withColumn("net", (F.col("position") * F.col("ret") - cost_bps * BPS * F.abs(F.col("position") - before)) * 1e4)


def pooled_statistic(panel: DataFrame, cost_bps: float) -> DataFrame:
    """Mean net return of all observations of all series, in basis points; ``panel`` has series, time, position, ret."""
    rows = _pooled(panel.withColumn("i", F.col("time")), ["series"], cost_bps)
    return rows.agg(F.coalesce(F.avg("net"), F.lit(0.0)).alias("bps"), F.count("net").alias("observations"))


def panel_test(panel: DataFrame, shifts: DataFrame, cost_bps: float, common: bool = True) -> DataFrame:
    """The pooled statistic against rotations; the observed arrangement counts as one of them.

    ``panel`` is aligned: each series has a row at each time. With ``common`` one shift turns the whole market.
    """
    each = panel_rotations(panel, cost_bps)
    bps = (F.sum("net") / F.nullif(F.sum("seen"), F.lit(0)) * 1e4).alias("bps")
    actual = each.where("shift = 0").agg(bps.alias("actual_bps"), F.sum("seen").alias("observations"))
    place = (_shift(F.col("n")) % F.col("n")).alias("shift")
    if common:  # turned together, so summed over the series before they are asked for
        by_shift = each.groupBy("n", "shift").agg(bps)
        asked = by_shift.select("n").distinct().join(F.broadcast(shifts)).select("trial", "n", place)
        drawn = by_shift.join(asked, ["n", "shift"]).select("trial", "bps")
    else:
        own = each.where("shift = 0").select("series", "n").join(F.broadcast(shifts)).withColumn("draw", F.pmod(F.xxhash64("draw", "series"), F.lit(1_000_003)))
        drawn = each.join(own.select("series", "trial", place), ["series", "shift"]).groupBy("trial").agg(bps)
    lists = drawn.join(F.broadcast(actual)).groupBy("actual_bps", "observations").agg(
        F.array_sort(F.collect_list("bps")).alias("draws"),
        F.count_if(F.col("bps") >= F.col("actual_bps") - 1e-9 * (1 + F.abs("actual_bps"))).alias("beat"),
        F.count(F.lit(1)).alias("trials"),
    )
    at = lambda f: F.element_at("draws", (F.least(F.floor(f * F.size("draws")), F.size("draws") - 1) + 1).cast("int"))
    return lists.select(
        "observations", "actual_bps", at(0.5).alias("median_bps"), at(0.05).alias("p05_bps"), at(0.95).alias("p95_bps"),
        ((F.col("beat") + 1) / (F.col("trials") + 1)).alias("p_value"), "trials",
    )


def per_series(panel: DataFrame, cost_bps: float) -> DataFrame:
    rows = _pooled(panel.withColumn("i", F.col("time")), ["series"], cost_bps)
    return rows.groupBy("series").agg(
        F.count("net").alias("bars"),
        F.coalesce(F.avg("net"), F.lit(0.0)).alias("net_bps"),
        F.avg((F.abs("position") > 1e-9).cast("double")).alias("exposure"),
    )
