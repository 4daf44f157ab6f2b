"""A universe of series, bar lengths and kinds of model, each walked forward, held against rotations and perfect foresight.

A cell is (series, bar length, kind). What a cell gives is kept in a table by a key of its content: a hash of the configuration
and of the bars it saw. A second run computes only the cells whose key is not there (an anti-join); cells of series that have
grown, or of another configuration, have other keys. A cell that cannot be had is a row that says why.

All that is asked of a cell is grouped by series, so without a break it would be one stage, and one task would hold a buffer
for each of its windows and sorts at once, four cells over. Bars, traded rows and what is measured of them are settled one
by one: a task has the buffers of one of these steps, whatever number of cells there is, and ticks are read once.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B, features as X, nulls, strategy
from ..operators.screen import best_cells
from ..session import settled
from . import grouped

_RESULT = (
    "key string, series string, cell string, factor int, kind string, bars long, trades long, exposure double, total_return double, buy_hold double, sharpe double, "
    "ceiling double, median_random double, excess double, p_value double, skipped string, saved_at long"
)
RESULT_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


@dataclass(frozen=True)
class Plan:
    """What is swept: base bars in a bar of each length, kinds of model, sizes of a walk-forward, and how cells are judged."""

    factors: tuple[int, ...] = (1, 2)
    kinds: tuple[str, ...] = grouped.KINDS
    train: int = 1500
    test: int = 500
    states: int = 3
    restarts: int = 4
    most: int = 30
    price: float = 1.0
    trials: int = 200
    seed: int = 42
    hold: int = 20
    bars_per_year: float = 8766.0
    rule: strategy.Strategy = field(default_factory=strategy.Strategy)

    def options(self, kind: str) -> dict:
        return {"price": self.price} if kind == "jump" else {"most": self.most} if kind.endswith("hsmm") else {}


def cell_keys(bars: DataFrame, plan: Plan) -> DataFrame:
    """key, series, factor and kind of every cell: hashes of the configuration and of all bars of the series."""
    seen = bars.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64(F.lit(i), "time", "open", "high", "low", "close", "volume")).alias(f"h{i}") for i in (1, 2))
    )
    config = json.dumps({k: v for k, v in asdict(plan).items() if k not in ("factors", "kinds")}, sort_keys=True)
    grid = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.lit(k).alias("kind")) for f in plan.factors for k in plan.kinds)))
    parts = [F.lit(config), F.col("g.factor").cast("string"), F.col("g.kind"), F.col("series"), *(F.col(c).cast("string") for c in ("n", "h1", "h2"))]
    return seen.withColumn("g", grid).select(F.sha2(F.concat_ws("|", *parts), 256).alias("key"), "series", "g.factor", "g.kind")


def stored(spark: SparkSession, path: str, now: int | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """The table of cells at ``path``, the newest of each key, as far as it is no older than ``ttl_seconds``; empty where there is none."""
    try:
        table = spark.read.schema(_RESULT).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _RESULT)
    if ttl_seconds is not None:
        table = table.where(F.col("saved_at") > now - ttl_seconds)
    return table.groupBy("key").agg(F.max_by(F.struct(*RESULT_NAMES[1:]), "saved_at").alias("r")).select("key", "r.*")


def walked(bars: DataFrame, factor: int, kind: str, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Traded rows of the tests of all series for one bar length and kind, and why series have none (series, failed)."""
    rows = X.price_features(B.rollup(bars, factor))
    names = list(X.PRICE_FEATURES)
    told = grouped.walk_forward(rows, names, kind, plan.states, plan.train, plan.test, plan.seed, plan.restarts, **plan.options(kind))
    told = settled(told)
    decided = strategy.decide(told.drop("probs"), plan.rule).select("series", "row", "position")
    held = rows.join(decided, ["series", "row"], "left").withColumn("position", F.coalesce("position", F.lit(0.0)))
    return settled(strategy.traded(held, plan.train)), told.groupBy("series").agg(F.max("skipped").alias("failed"))


def computed(bars: DataFrame, keys: DataFrame, factor: int, kind: str, plan: Plan, now: int) -> DataFrame:
    """Results of the cells of one bar length and kind for the series of ``keys`` (key and series)."""
    done, failed = walked(bars.join(keys.select("series"), "series", "left_semi"), factor, kind, plan)
    measured = strategy.metrics(done, plan.rule.cost_bps, plan.bars_per_year / factor)
    luck = nulls.permutation_test(done, nulls.shift_table(bars.sparkSession, plan.trials), plan.rule.cost_bps).drop("exposure")
    most = nulls.ceiling(done, (plan.hold,), (plan.rule.cost_bps,)).select("series", F.col("roi").alias("ceiling"), "buy_hold")
    found = settled(measured).join(settled(luck), "series").join(settled(most), "series")
    every = keys.join(failed, "series", "left").join(found, "series", "left")
    why = F.coalesce("failed", F.when(F.coalesce("bars", F.lit(0)) < plan.test, "too few bars"))
    own = {
        "cell": F.lit(f"{factor}/{kind}"), "factor": F.lit(factor), "kind": F.lit(kind), "trades": F.col("position_changes"), "skipped": why,
        "excess": F.col("actual") - F.col("median_random"), "saved_at": F.lit(now),
    }
    kinds = dict(c.split() for c in _RESULT.split(", "))
    return settled(every.select(*(own.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in RESULT_NAMES)))


def sweep(bars: DataFrame, plan: Plan, path: str | None = None, now: int = 0, ttl_seconds: int | None = None) -> DataFrame:
    """One row a cell, as RESULT_NAMES. With a ``path`` only cells that are not stored there (or have expired) are computed, and stored."""
    spark, bars = bars.sparkSession, settled(bars)
    wanted = settled(cell_keys(bars, plan))
    known = settled(stored(spark, path, now, ttl_seconds).join(wanted.select("key"), "key", "left_semi")) if path else None
    missing = settled(wanted.join(known.select("key"), "key", "left_anti")) if path else wanted
    todo = [(r["factor"], r["kind"]) for r in missing.select("factor", "kind").distinct().orderBy("factor", "kind").collect()]  # bounded by the plan
    new = [computed(bars, missing.where((F.col("factor") == f) & (F.col("kind") == k)).select("key", "series"), f, k, plan, now) for f, k in todo]
    if not path:
        return reduce(DataFrame.unionByName, new) if new else spark.createDataFrame([], _RESULT)
    for part in new:  # a cell that is written is there for the next run, even if a later one fails
        part.write.mode("append").parquet(path)
    return stored(spark, path, now, ttl_seconds).join(wanted.select("key"), "key", "left_semi")


def net_returns(bars: DataFrame, cells: DataFrame, plan: Plan) -> DataFrame:
    """series, cell, row, time and net of every test row of the given cells (series, factor, kind), computed anew."""
    pairs = [(r["factor"], r["kind"]) for r in cells.select("factor", "kind").distinct().orderBy("factor", "kind").collect()]
    out = []
    for factor, kind in pairs:
        own = cells.where((F.col("factor") == factor) & (F.col("kind") == kind)).select("series")
        done, _ = walked(bars.join(own, "series", "left_semi"), factor, kind, plan)
        out.append(strategy.accounted(done, plan.rule.cost_bps).select("series", F.lit(f"{factor}/{kind}").alias("cell"), "row", "time", "net"))
    return reduce(DataFrame.unionByName, out)


def rebuilt(bars: DataFrame, cells: DataFrame, plan: Plan, tolerance: float = 1e-9) -> DataFrame:
    """series, cell, total_return, again and same: stored cells against the same cells computed anew from the bars."""
    kept = cells.where(F.col("skipped").isNull())
    again = net_returns(bars, kept, plan).groupBy("series", "cell").agg((F.product(1 + F.col("net")) - 1).alias("again"))
    both = kept.select("series", "cell", "total_return").join(again, ["series", "cell"], "left")
    near = F.abs(F.col("total_return") - F.col("again")) <= tolerance * (1 + F.abs("total_return"))
    return both.withColumn("same", F.coalesce(near, F.lit(False)))


def best_models(bars: DataFrame, cells: DataFrame, plan: Plan) -> DataFrame:
    """The best cell's model of each series, refitted on all rows of it: a model row with cell, and the means and deviations of its scaler."""
    best = settled(best_cells(cells))
    names, out = list(X.PRICE_FEATURES), []
    for factor, kind in [(r["factor"], r["kind"]) for r in best.select("factor", "kind").distinct().orderBy("factor", "kind").collect()]:
        own = best.where((F.col("factor") == factor) & (F.col("kind") == kind)).select("series", "cell")
        rows = X.price_features(B.rollup(bars.join(own, "series", "left_semi"), factor))
        scaler = X.fit_scaler(rows, X.PRICE_FEATURES, F.lit(True))
        models = grouped.fit_models(X.scale(rows, scaler, X.PRICE_FEATURES), names, kind, plan.states, plan.restarts, plan.seed, **plan.options(kind))
        out.append(models.join(own, "series").join(scaler, "series"))
    return reduce(DataFrame.unionByName, out) if out else bars.sparkSession.createDataFrame([], f"series string, kind string, {grouped._MODEL}, cell string")
