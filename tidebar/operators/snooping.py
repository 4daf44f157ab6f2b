"""Data-snooping corrections for the best of many strategies on one clock.

``cells``: series (the strategy's name), i (0, 1 ..) and value, the net log return at each time of one grid. Resamples
are a table of blocks (b, first, length), the same for all strategies, so their dependence is kept. Means of resamples are
one equi-join of the blocks' ends with running sums and one grouped aggregate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.special import EULER, normal_cdf, normal_inv
from ..session import settled
from .align import bucket_grid

_PRIME = 2_147_483_647


def _draw(*terms: Column) -> Column:
    """A repeatable draw below 2**31 - 1 from whole numbers."""
    mixed = terms[0] * 7919 + terms[1] * 104_729 + 13
    return (mixed * 48_271 % _PRIME) * 16_807 % _PRIME


def resample_table(spark: SparkSession, n: int, resamples: int, block: float) -> DataFrame:
    """Stationary bootstrap: at each place a new block begins with probability 1 / block, else the last one goes on, round the end."""
    rows = spark.range(resamples * n).select(F.floor(F.col("id") / n).alias("b"), (F.col("id") % n).alias("i"))
    fresh = (F.col("i") == 0) | (_draw(F.col("b"), F.col("i")) < int(_PRIME / block))
    start = F.when(fresh, F.struct(F.col("i").alias("at"), (_draw(F.col("b") + 1_000_003, F.col("i")) % n).alias("first")))
    last = F.last(start, True).over(Window.partitionBy("b").orderBy("i"))
    return rows.withColumn("_s", last).select("b", "i", ((F.col("_s.first") + F.col("i") - F.col("_s.at")) % n).alias("j"))


def resample_blocks(spark: SparkSession, n: int, resamples: int, block: float) -> DataFrame:
    """The resamples of :func:`resample_table` as blocks: b, first place in the sample, and length; n / block rows a resample."""
    rows = spark.range(resamples * n).select(F.floor(F.col("id") / n).alias("b"), (F.col("id") % n).alias("i"))
    fresh = rows.where((F.col("i") == 0) | (_draw(F.col("b"), F.col("i")) < int(_PRIME / block)))
    end = F.coalesce(F.lead("i").over(Window.partitionBy("b").orderBy("i")), F.lit(n))
    return fresh.select("b", (_draw(F.col("b") + 1_000_003, F.col("i")) % n).alias("first"), (end - F.col("i")).alias("length"))


def block_means(cells: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """series, b and the mean of resample b, from running sums: a block is the difference of two of them, and goes round the end.

    All strategies share one grid of n places, so the weights of the running sums are those of all of them.
    """
    end = F.col("first") + F.col("length")
    at = lambda k, w: F.struct(k.alias("k"), w.cast("double").alias("w"))
    terms = F.array(at(end % n, F.lit(1)), at(F.lit(n).cast("long"), F.floor(end / n)), at(F.col("first"), F.lit(-1)))
    weights = blocks.select("b", F.inline(terms)).where("k > 0").groupBy("b", "k").agg(F.sum("w").alias("w")).where("w <> 0")
    running = Window.partitionBy("series").orderBy("i")
    sums = cells.select("series", (F.col("i") + 1).alias("k"), F.sum("value").over(running).alias("s"))
    return weights.join(sums, "k").groupBy("series", "b").agg((F.sum(F.col("w") * F.col("s")) / n).alias("boot"))


def block_length(values: np.ndarray) -> float:
    """Block length by the flat-top rule, from where autocorrelation dies out; 1 for short or constant samples."""
    n = len(values)
    x = values - values.mean()
    variance = float((x * x).sum() / n) if n else 0.0
    # a constant sample varies by rounding alone
    if n < 8 or math.sqrt(variance) <= 1e-12 * (float(np.abs(values).max()) or 1.0):
        return 1.0
    quiet = max(5, math.ceil(math.sqrt(math.log10(n))))  # lags in a row that must be within the band
    widest = math.ceil(math.sqrt(n)) + quiet
    reach = min(n - 1, widest + quiet)
    cov = np.array([(x[: n - k] * x[k:]).sum() / n for k in range(reach + 1)])
    size, band = np.abs(cov / cov[0]), 2 * math.sqrt(math.log10(n) / n)
    m = next((m for m in range(1, reach - quiet + 1) if (size[m + 1 : m + quiet + 1] < band).all()), None)
    if m is None:  # it never dies out: the largest lag that is beyond the band
        loud = np.flatnonzero(size[1:] > band)
        if not len(loud):
            return 1.0
        m = int(loud[-1]) + 1
    most = max(1, min(2 * m, widest, n - 1))
    lag = np.arange(1, most + 1)
    weight = np.clip(2 * (1 - lag / most), 0, 1)
    used = np.array([(x[: n - k] * x[k:]).sum() / n for k in lag])
    g, spectrum = 2 * (weight * lag * used).sum(), cov[0] + 2 * (weight * used).sum()
    if spectrum == 0 or not math.isfinite(g):
        return 1.0
    best = (g * g / spectrum**2) ** (1 / 3) * n ** (1 / 3)
    return float(min(best, math.ceil(min(3 * math.sqrt(n), n / 3)))) if best >= 1 else 1.0


def block_lengths(cells: DataFrame) -> DataFrame:
    """series and its block length; one task a strategy, which holds one grid of values."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values("i")["value"].to_numpy()
        return pd.DataFrame({"series": rows["series"].iloc[:1], "block": [block_length(values)]})

    return cells.groupBy("series").applyInPandas(run, "series string, block double")


def long_run(cells: DataFrame, block: float) -> DataFrame:
    """series, n, mean and omega: the deviation of sqrt(n) times the mean under the stationary bootstrap.

    Autocovariances come from a join of each sample with itself at a lag; lags end where their weight is below 1e-12.
    """
    q = 1 / block
    stats = cells.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    n, k = F.col("n"), F.col("lag")
    weight = (n - k) / n * F.pow(F.lit(1 - q), k) + k / n * F.pow(F.lit(1 - q), n - k)
    centred = cells.join(stats, "series").withColumn("x", F.col("value") - F.col("mean"))
    reach = 1 if block <= 1 else math.ceil(math.log(1e-13) / math.log(1 - q))
    lags = F.explode(F.sequence(F.lit(0), F.least(F.col("n") - 1, F.lit(reach))))
    left = centred.withColumn("lag", lags).select("series", "n", "lag", (F.col("i") + F.col("lag")).alias("i"), F.col("x").alias("y"))
    pairs = left.join(centred.select("series", "i", "x"), ["series", "i"])
    cov = pairs.groupBy("series", "n", "lag").agg((F.sum(F.col("x") * F.col("y")) / F.max("n")).alias("c"))
    part = F.when(F.col("lag") == 0, F.col("c")).otherwise(F.when(weight >= 1e-12, 2 * weight * F.col("c")).otherwise(0.0))
    total = cov.withColumn("part", part).groupBy("series").agg(F.sum("part").alias("v"))
    return stats.join(total, "series").select("series", "n", "mean", F.sqrt(F.greatest("v", F.lit(0.0))).alias("omega"))


def resample_means(cells: DataFrame, resamples: DataFrame) -> DataFrame:
    """series, b and the mean of resample b."""
    return resamples.join(cells.withColumnRenamed("i", "j"), "j").groupBy("series", "b").agg(F.avg("value").alias("boot"))


def _p(exceed: Column, trials: Column) -> Column:
    return (1 + exceed) / (trials + 1)


def reality_check(stats: DataFrame, means: DataFrame) -> DataFrame:
    """The largest mean, not studentised, against the largest of the recentred resamples."""
    scaled = stats.select("series", "mean", F.sqrt("n").alias("root"))
    actual = scaled.agg(F.max(F.col("root") * F.col("mean")).alias("statistic"), F.max_by("series", F.struct(F.col("root") * F.col("mean"), "series")).alias("best"))
    top = means.join(scaled, "series").groupBy("b").agg(F.max(F.col("root") * (F.col("boot") - F.col("mean"))).alias("v"))
    joined = top.join(actual).groupBy("best", "statistic").agg(F.count_if(F.col("v") >= F.col("statistic")).alias("x"), F.count(F.lit(1)).alias("trials"))
    return joined.select("best", "statistic", _p(F.col("x"), F.col("trials")).alias("p_value"))


def t_statistics(stats: DataFrame) -> DataFrame:
    """Adds t, 0 for a strategy that never varies."""
    return stats.withColumn("t", F.when(F.col("omega") > 0, F.sqrt("n") * F.col("mean") / F.nullif("omega", F.lit(0.0))).otherwise(0.0))


def spa(stats: DataFrame, means: DataFrame) -> DataFrame:
    """Superior predictive ability: the studentised maximum, with poor strategies recentred at none, some or all of them."""
    t = t_statistics(stats)
    lil = F.when(F.col("n") >= 16, F.sqrt(2 * F.log(F.log(F.col("n").cast("double"))))).otherwise(0.0)
    bar = -F.col("omega") / F.sqrt("n") * lil
    centre = {"upper": F.col("mean"), "lower": F.greatest("mean", F.lit(0.0)), "consistent": F.when(F.col("mean") >= bar, F.col("mean")).otherwise(0.0)}
    t = t.withColumns({f"g_{k}": v for k, v in centre.items()})
    actual = t.agg(F.greatest(F.max("t"), F.lit(0.0)).alias("statistic"), F.max_by("series", F.struct("t", "series")).alias("best"), F.count(F.lit(1)).alias("models"))
    z = means.join(t.where("omega > 0"), "series")
    over = [F.greatest(F.max(F.sqrt("n") * (F.col("boot") - F.col(f"g_{k}")) / F.col("omega")), F.lit(0.0)).alias(k) for k in centre]
    top = means.select("b").distinct().join(z.groupBy("b").agg(*over), "b", "left").na.fill(0.0)
    counted = top.join(actual).groupBy("best", "statistic", "models").agg(
        *(F.count_if(F.col(k) >= F.col("statistic")).alias(f"x_{k}") for k in centre), F.count(F.lit(1)).alias("trials")
    )
    return counted.select("best", "statistic", "models", *(_p(F.col(f"x_{k}"), F.col("trials")).alias(f"p_{k}") for k in centre))


def step_down(stats: DataFrame, means: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adjusted p-values of all strategies: each against the largest resample of itself and those ranked below it."""
    t = t_statistics(stats)
    ranked = t.withColumn("rank", F.row_number().over(Window.orderBy(F.col("t").desc(), "series")))  # one row a strategy
    z = means.join(ranked, "series").withColumn("z", F.when(F.col("omega") > 0, F.sqrt("n") * (F.col("boot") - F.col("mean")) / F.nullif("omega", F.lit(0.0))))
    below = Window.partitionBy("b").orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    z = z.withColumn("top", F.max("z").over(below))
    raw = z.groupBy("series", "t", "rank").agg(_p(F.count_if(F.col("top") >= F.col("t")), F.count(F.lit(1))).alias("raw"))
    adjusted = F.max("raw").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn("adjusted_p", adjusted).select("series", "t", "rank", "adjusted_p", (F.col("adjusted_p") <= alpha).alias("rejected"))


def moments(rows: DataFrame, value: str = "value", key: str = "series") -> DataFrame:
    """Sharpe (population), skew and kurtosis (not in excess) of each series; 0, 0 and 3 where it does not vary."""
    mean = rows.groupBy(key).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"))
    d = F.col(value) - F.col("m")
    powers = rows.join(mean, key).groupBy(key, "m", "n").agg(*(F.avg(F.pow(d, F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)))
    alive = F.col("m2") > 0
    v = F.nullif("m2", F.lit(0.0))
    return powers.select(
        key, "n", F.when(alive, F.col("m") / F.sqrt(v)).otherwise(0.0).alias("sharpe"),
        F.when(alive, F.col("m3") / F.pow(v, F.lit(1.5))).otherwise(0.0).alias("skew"), F.when(alive, F.col("m4") / (v * v)).otherwise(3.0).alias("kurtosis"),
    )


def effective_trials(cells: DataFrame) -> DataFrame:
    """Mean correlation of all pairs of strategies and how many independent ones they are worth.

    With standardised columns the mean correlation follows from the variance of their sum: one pass, no pairs.
    """
    stats = cells.groupBy("series").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = cells.join(stats, "series").withColumn("z", F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.nullif("s", F.lit(0.0))).otherwise(0.0))
    live = stats.agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("s") > 0).alias("live"))
    total = z.groupBy("i").agg(F.sum("z").alias("s")).agg(F.avg(F.col("s") * F.col("s")).alias("v"))
    pairs = F.nullif(F.col("m") * (F.col("m") - 1), F.lit(0))
    rho = F.coalesce((F.col("v") - F.col("live")) / pairs, F.lit(0.0))
    found = total.join(live).select(F.col("m").alias("models"), rho.alias("rho"))
    return found.withColumn("effective", F.greatest(F.lit(1.0), F.col("rho") + (1 - F.col("rho")) * F.col("models")))


def pair_correlations(cells: DataFrame, least: int = 30) -> DataFrame:
    """Correlation of each pair of series over the times both have, at least ``least`` of them."""
    a, b = cells.alias("a"), cells.alias("b")
    pairs = a.join(b, (F.col("a.time") == F.col("b.time")) & (F.col("a.series") < F.col("b.series")))
    x, y = F.col("a.value"), F.col("b.value")
    stats = pairs.groupBy(F.col("a.series").alias("left"), F.col("b.series").alias("right")).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy")
    )
    kept = stats.where((F.col("n") >= least) & (F.col("vx") > 0) & (F.col("vy") > 0))
    return kept.select("left", "right", "n", (F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).alias("rho"))


def expected_max_sharpe(trials: int, variance: float) -> float:
    n = max(trials, 2)
    return math.sqrt(max(variance, 0.0)) * ((1 - EULER) * normal_inv(1 - 1 / n) + EULER * normal_inv(1 - 1 / (n * math.e)))


def probabilistic_sharpe(observed: float, benchmark: float, bars: int, skew: float = 0.0, kurtosis: float = 3.0) -> float | None:
    """Probability that the true Sharpe is above the benchmark; None where its error is not defined."""
    spread = 1 - skew * observed + (kurtosis - 1) / 4 * observed**2
    if bars < 2 or spread <= 0:
        return None
    return normal_cdf((observed - benchmark) * math.sqrt(bars - 1) / math.sqrt(spread))


def deflated_sharpe(stats: DataFrame) -> DataFrame:
    """For each strategy of :func:`moments` the probability that it beats the best of as many lucky ones."""
    family = stats.agg(F.count(F.lit(1)), F.var_samp("sharpe")).first()
    bar = expected_max_sharpe(family[0], family[1] or 0.0)

    def run(batches):
        for rows in batches:
            out = [probabilistic_sharpe(s, bar, n, g, k) for s, n, g, k in zip(*(rows[c] for c in ("sharpe", "n", "skew", "kurtosis")))]
            yield pd.DataFrame({"series": rows.series, "sharpe": rows.sharpe, "benchmark": bar, "deflated": out})

    return stats.select("series", "n", "sharpe", "skew", "kurtosis").mapInPandas(run, "series string, sharpe double, benchmark double, deflated double")


def family_block(cells: DataFrame) -> float:
    """One block length for a family on one clock: the upper median of those of its strategies."""
    lengths = block_lengths(cells).agg(F.array_sort(F.collect_list("block")).alias("b"))  # one number a strategy
    found = lengths.select(F.element_at("b", (F.floor(F.size("b") / 2) + 1).cast("int"))).first()
    return max(1.0, found[0]) if found and found[0] is not None else 1.0


def judge(logs: DataFrame, seconds: int, resamples: int, block: float | None = None) -> DataFrame:
    """The best strategy of a sweep under every correction: one row.

    ``logs``: series, time, value (log net returns) and step, the seconds of the strategy's own bar. Tests run on one
    grid of ``seconds``; Sharpes of unlike bars are put on it by the root of how many bars a bucket holds.
    """
    grid = settled(bucket_grid(logs, "value", seconds).withColumn("i", place_on_grid(seconds)))
    block = block or family_block(grid)
    n = grid.agg(F.max("i")).first()[0] + 1
    stats, means = settled(long_run(grid, block)), settled(block_means(grid, resample_blocks(grid.sparkSession, n, resamples, block), n))
    bars = F.col("seconds") / F.col("step")
    own = moments(logs).join(logs.groupBy("series").agg(F.max("step").alias("step")), "series").withColumn("seconds", F.lit(seconds))
    own = own.select("series", (F.col("sharpe") * F.sqrt(bars)).alias("sharpe"), "skew", "kurtosis", F.floor(F.col("n") / bars + 0.5).cast("long").alias("n"))
    best = own.agg(F.min_by(F.struct("series", "sharpe", "skew", "kurtosis", "n"), F.struct(-F.col("sharpe"), F.col("series"))).alias("w"), F.count(F.lit(1)).alias("models"), F.var_samp("sharpe").alias("v"))
    one = best.select("w.*", "models", F.coalesce("v", F.lit(0.0)).alias("v")).join(F.broadcast(effective_trials(grid).select("rho", "effective")))
    tested = spa(stats, means).select(F.col("best").alias("spa_best"), "statistic", "p_upper", "p_lower", "p_consistent")
    # each side is the one row of an aggregate over everything
    one = one.join(F.broadcast(tested)).join(F.broadcast(reality_check(stats, means).select(F.col("p_value").alias("rc_p"))))
    one = one.join(F.broadcast(step_down(stats, means).agg(F.min("adjusted_p").alias("rw_p"), F.count_if("rejected").alias("rejected"))))

    def run(batches):
        for rows in batches:
            bar = [expected_max_sharpe(int(m), v) for m, v in zip(rows.models, rows.v)]
            less = [expected_max_sharpe(round(e), v) for e, v in zip(rows.effective, rows.v)]
            score = lambda b: [probabilistic_sharpe(*r) for r in zip(rows.sharpe, b, rows.n, rows["skew"], rows["kurtosis"])]
            yield rows.assign(block=block, buckets=n, expected_max=bar, deflated=score(bar), deflated_effective=score(less)).drop(columns=["v"])

    kinds = dict(one.dtypes)
    own = [c for c in one.columns if c != "v"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", block double, buckets long, expected_max double, deflated double, deflated_effective double"
    return one.mapInPandas(run, schema)


def place_on_grid(seconds: int) -> Column:
    """0, 1 .. of each series' times on a common grid."""
    return ((F.col("time") - F.min("time").over(Window.partitionBy("series"))) / seconds).cast("long")
