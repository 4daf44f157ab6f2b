"""Does a forecast order the returns that follow? Pooled correlations of an aligned panel against rotations of it.

``panel`` is aligned: series, time, forecast and ret, null where a side is missing. All series are pooled; one shift turns
them all, so what they have in common stays. Each arrangement is one group of rows, bars by series, with its own ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .align import numbered_times
from .ic import mid_rank, pearson
from .nulls import _shift

#: The arrangement that was observed, among the trials.
ACTUAL = -1
#: Ranges of values that are ranked apart.
RANK_PARTS = 64


def forward_return(horizon: int) -> Column:
    """Compounded return of this and the next bars, null where one of them is missing."""
    ahead = Window.partitionBy("series").orderBy("i").rowsBetween(0, horizon - 1)
    whole = F.count(F.when(~F.isnan("ret"), F.col("ret"))).over(ahead) == horizon
    return F.when(whole, F.product(1 + F.col("ret")).over(ahead) - 1)


def arrangements(panel: DataFrame, shifts: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """trial, horizon, forecast and ret of every valid pair, of the observed arrangement and of the rotated ones."""
    own = panel.join(numbered_times(panel), "time")
    later = own.withColumns({f"ret_{h}": forward_return(h) for h in horizons})
    returns = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}").alias("ret")) for h in horizons))
    later = later.select("series", "i", "n", F.explode(returns).alias("r")).select("series", "i", "n", "r.*").where("ret is not null")
    observed = later.withColumns({"trial": F.lit(ACTUAL).cast("long"), "j": F.col("i")})
    turned = later.join(F.broadcast(shifts)).withColumn("j", (F.col("i") + _shift(F.col("n"))) % F.col("n")).drop("draw")
    said = own.select("series", F.col("i").alias("j"), "forecast").where("forecast is not null and not isnan(forecast)")
    return observed.unionByName(turned).join(said, ["series", "j"]).select("trial", "horizon", "forecast", "ret")


def distributed_ranks(pairs: DataFrame, columns: dict[str, str], keys: tuple[str, ...] = ("trial", "horizon"), shared: str = "horizon", sample: Column | None = None) -> DataFrame:
    """``pairs`` with the mid-rank of each of ``columns`` (value: name) within ``keys``, no matter how many rows a key has.

    Splitters between ``RANK_PARTS`` ranges come from the rows of ``sample`` of each ``shared`` key, whose values the other keys have
    too, in another order. A row's rank is its rank within its range and how many rows of its key the ranges below hold.
    """
    at = [k / RANK_PARTS for k in range(1, RANK_PARTS)]
    known = pairs.where(sample) if sample is not None else pairs
    edges = known.groupBy(shared).agg(*(F.percentile_approx(c, at, 1000).alias(f"_edges_{c}") for c in columns))  # a row a shared key
    out = pairs.join(F.broadcast(edges), shared)
    for c, name in columns.items():
        part = f"_part_{c}"
        value = F.col(c)
        out = out.withColumn(part, F.size(F.filter(f"_edges_{c}", lambda e: e < value))).drop(f"_edges_{c}")  # noqa: B023
        below = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        counts = out.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"))
        offsets = counts.select(*keys, part, F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
        out = out.join(offsets, [*keys, part]).withColumn(name, F.col("_below") + mid_rank(c, *keys, part)).drop("_below", part)
    return out


def forecast_test(panel: DataFrame, shifts: DataFrame, horizons: tuple[int, ...] = (1,)) -> DataFrame:
    """One row: observations, slope, ic, rank_ic and their p-values, of the first horizon; rank_ic is the mean over all of them.

    ``p_value``: as large an ic or larger. ``p_rank``: a rank_ic as far from the trials' median, either way. ``p_rank_lower``: as
    small a rank_ic, which only counts where the direction was fixed beforehand. The observed arrangement counts as one trial.
    """
    pairs = settled(arrangements(settled(panel), shifts, horizons))  # read for splitters, offsets and ranks
    keys = ("trial", "horizon")
    ranked = distributed_ranks(pairs, {"forecast": "rf", "ret": "rr"}, keys, sample=F.col("trial") == ACTUAL)
    zero = F.lit(0.0)
    slope = F.coalesce(F.covar_pop("forecast", "ret") / F.nullif(F.var_pop("forecast"), zero), zero)
    each = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(pearson("forecast", "ret", 1), zero).alias("ic"), F.coalesce(pearson("rf", "rr", 1), zero).alias("rank"), slope.alias("slope")
    )
    first = F.col("horizon") == horizons[0]
    by_trial = each.groupBy("trial").agg(
        *(F.max(F.when(first, F.col(c))).alias(c) for c in ("n", "ic", "slope")), (F.sum("rank") / len(horizons)).alias("rank")
    )
    observed = by_trial.where(F.col("trial") == ACTUAL).select(F.col("n").alias("observations"), "slope", "ic", F.col("rank").alias("rank_ic"))
    drawn = by_trial.where(F.col("trial") != ACTUAL).agg(
        F.array_sort(F.collect_list("ic")).alias("ics"), F.array_sort(F.collect_list("rank")).alias("ranks"), F.count(F.lit(1)).alias("trials")
    )
    at = lambda v, f: F.element_at(v, (F.least(F.floor(f * F.size(v)), F.size(v) - 1) + 1).cast("int"))
    both = observed.join(drawn).withColumn("centre", at("ranks", 0.5))
    share = lambda v, test: (F.size(F.filter(v, test)) + 1) / (F.col("trials") + 1)
    far = F.abs(F.col("rank_ic") - F.col("centre"))
    return both.select(
        "observations", "slope", "ic", "rank_ic", share("ics", lambda d: d >= F.col("ic")).alias("p_value"), share("ranks", lambda d: F.abs(d - F.col("centre")) >= far).alias("p_rank"),
        share("ranks", lambda d: d <= F.col("rank_ic")).alias("p_rank_lower"), at("ics", 0.5).alias("median_ic"), at("ics", 0.05).alias("p05_ic"), at("ics", 0.95).alias("p95_ic"),
        F.col("centre").alias("median_rank_ic"), at("ranks", 0.05).alias("p05_rank_ic"), at("ranks", 0.95).alias("p95_rank_ic"), "trials",
    )
