"""From models to decisions: the last bar under a saved model, fitted timeframes in agreement, and one panel for all series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bars as B, confluence, features as X
from ..operators.strategy import Strategy, next_position
from . import chain
from .grouped import fitted, from_row, predict


def signal_now(features: DataFrame, scaler: DataFrame, models: DataFrame, names: list[str], kind: str, plan: Strategy, held: DataFrame | None = None) -> DataFrame:
    """What to hold after the last bar of each series: nothing is fitted here.

    ``scaler`` (of :func:`features.fit_scaler`) and ``models`` are saved tables; ``held`` has series and previous, the position
    at hand. Gives series, time, target, expected, hold, state and probs; a series whose model failed has no row.
    """
    scaled = X.scale(features.select("series", "row", "time", *names), scaler, tuple(names))
    at = names.index("realized_vol") if "realized_vol" in names else None

    def run(rows: pd.DataFrame, saved: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in _SIGNAL.split(", ")]
        if not len(rows) or not len(saved) or saved["skipped"].iloc[0] is not None:
            return pd.DataFrame(columns=columns)
        rows, m = rows.sort_values("row"), from_row(saved.iloc[0], len(names))
        now, ahead = predict(m, rows[names].to_numpy(float), kind)
        unit = lambda i: (float(saved[f"{names[i]}_mean"].iloc[0]), float(saved[f"{names[i]}_sd"].iloc[0]))
        mean, sd = unit(0)
        vol = 0.0
        if at is not None:
            vol_mean, vol_sd = unit(at)
            vol = float(ahead[-1] @ np.exp(m.mu[:, at] * vol_sd + vol_mean))
        last = rows.iloc[-1]
        hold = float(min(chain.expected_durations(m)[-1], 1e9))
        found = (last["series"], int(last["time"]), float(ahead[-1] @ (m.mu[:, 0] * sd + mean)), vol, hold, float(ahead[-1, -1]), int(now[-1].argmax()), ahead[-1].tolist())
        return pd.DataFrame([found], columns=columns)

    both = models.join(scaler, "series")
    both = both.select(*(F.col(c).alias(c) for c in both.columns))  # of its own, also where all tables come from one
    tail = scaled.groupBy("series").cogroup(both.groupBy("series")).applyInPandas(run, _SIGNAL)
    tail = tail.join(held, "series", "left") if held is not None else tail.withColumn("previous", F.lit(0.0))
    tail = tail.withColumn("previous", F.coalesce("previous", F.lit(0.0)))
    return tail.select("series", "time", next_position(plan).alias("target"), "expected", "hold", "state", "probs")


_SIGNAL = "series string, time long, expected double, volatility double, hold double, top double, state int, probs array<double>"


def expanding_blocks(base: DataFrame, train: int, test: int) -> DataFrame:
    """series, block, train_end and test_end (rows): training begins with the series; a short rest joins the last block."""
    sizes = base.groupBy("series").agg((F.max("row") + 1).alias("n"))
    last = F.floor((F.col("n") - 2 - train) / test)
    blocks = sizes.where(last >= 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    end = F.least(F.col("block") * test + train + test, "n")
    blocks = blocks.withColumns({"train_end": F.col("block") * test + train, "test_end": F.when(F.col("n") - end < test / 2, F.col("n")).otherwise(end)})
    before = F.lag("test_end").over(Window.partitionBy("series").orderBy("block"))
    return blocks.withColumn("_before", before).where("_before is null or _before < n").select("series", "block", "train_end", "test_end")


def role_forecasts(bars: DataFrame, blocks: DataFrame, factor: int, kind: str = "hmm", states: int = 3, seed: int = 42, restarts: int = 2, window: int = X.WINDOW, **options) -> DataFrame:
    """series, block, higher_idx, expected, bull and bear of a timeframe, after the training rows of each block.

    Scaler and model see training rows only; fewer than twelve of them a state give no rows. Each block is a task.
    """
    names = list(X.PRICE_FEATURES)
    rows = X.price_features(B.rollup(bars, factor), window)
    inside = lambda end: F.greatest(F.floor((F.col(end) + window) / factor) - window, F.lit(0)).cast("long")
    spans = blocks.select("series", "block", inside("train_end").alias("learn"), inside("test_end").alias("upto")).where(f"learn >= {12 * states} and upto > learn")
    placed = rows.join(spans, "series").where(F.col("row") < F.col("upto")).select("series", "block", "row", "learn", *names)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        learn = (group["row"] < group["learn"]).to_numpy()
        done = fitted(group[names].to_numpy(float), learn, names, kind, states, [seed + 7919 * k for k in range(restarts)], options)
        if isinstance(done, str):
            return pd.DataFrame(columns=[c.split()[0] for c in _ROLE.split(", ")])
        _, ahead, means, _ = done
        out = group.loc[~learn, ["series", "block", "row"]]
        ahead = ahead[~learn]
        return pd.DataFrame({"series": out["series"], "block": out["block"], "higher_idx": out["row"] + window, "expected": ahead @ means, "bull": ahead[:, -1], "bear": ahead[:, 0]})

    return placed.groupBy("series", "block").applyInPandas(run, _ROLE)


_ROLE = "series string, block long, higher_idx long, expected double, bull double, bear double"


def walk_forward_confluence(
    bars: DataFrame, factors: dict[str, int], train: int = 2000, test: int = 500, rule: confluence.Rule = confluence.Rule(), window: int = X.WINDOW, **options
) -> DataFrame:
    """series, row, time, agreement and position of all test rows: three fitted timeframes vote on each base bar.

    ``factors``: base bars in a bar of each role. A role speaks once its bar has ended. Blocks begin without a position.
    """
    base = X.price_features(bars, window).select("series", "row", "idx", "time")
    blocks = expanding_blocks(base, train, test)
    tests = base.join(blocks, "series").where((F.col("row") >= F.col("train_end")) & (F.col("row") < F.col("test_end")))
    seen = tests.select("series", "block", "row", "idx", "time")
    for role in confluence.ROLES:
        said = role_forecasts(bars, blocks, factors[role], window=window, **options)
        said = said.select("series", "block", "higher_idx", *(F.col(c).alias(f"{role}_{c}") for c in ("expected", "bull", "bear")))
        ended = (F.floor((F.col("idx") + 1) / factors[role]) - 1).cast("long")
        seen = seen.withColumn("higher_idx", ended).join(said, ["series", "block", "higher_idx"], "left").drop("higher_idx")
    voted = confluence.votes(seen, rule).withColumnRenamed("series", "name")
    voted = voted.withColumn("series", F.concat_ws("/", "name", F.col("block").cast("string")))
    return confluence.combine(voted, rule).select(F.col("name").alias("series"), "row", "time", "agreement", "position")


def collect_panel(features: DataFrame, forecasts: DataFrame, decided: DataFrame, first_row: int) -> DataFrame:
    """series, time, position, ret and forecast of every test row: the same configuration on every series, none left out.

    Series without forecasts (too short, or a failed fit) have no rows; rows without a decision hold nothing.
    """
    ahead = F.exp(F.lead("log_return").over(Window.partitionBy("series").orderBy("row"))) - 1
    rows = features.withColumn("ret", ahead).where(F.col("ret").isNotNull() & (F.col("row") >= first_row))
    told = forecasts.select("series", "row", F.col("expected").alias("forecast"))
    rows = rows.join(told.select("series").distinct(), "series", "left_semi").join(told, ["series", "row"], "left")
    rows = rows.join(decided.select("series", "row", "position"), ["series", "row"], "left")
    return rows.select("series", "time", F.coalesce("position", F.lit(0.0)).alias("position"), "ret", F.coalesce("forecast", F.lit(0.0)).alias("forecast"))
