"""Models over all series at once: fits, beliefs, walk-forward blocks and posteriors as grouped maps.

A model is a row. Restarts, numbers of states and blocks are independent, so they are exploded into rows before the
grouped map and reduced by an aggregate after it; a group holds the rows of one series (or of one block of it), which
are bars, never ticks. A group that cannot be fitted gives a row that says why.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.features import unscaled
from ..session import settled
from . import bayes, blocked, chain, jump, semi
from .chain import Model

#: Rows of a series that one task fits, and names of longer ones that are sent to all tasks.
LONG, LONG_SERIES = 64 * blocked.BLOCK, 1000
KINDS = ("hmm", "hsmm", "student", "student_hsmm", "jump")
_ARRAYS = ("pi", "a", "mu", "var", "nu", "dur")
_MODEL = "states int, " + ", ".join(f"{c} array<double>" for c in _ARRAYS) + ", score double, rounds int, skipped string"
_MODEL_NAMES = [c.split()[0] for c in _MODEL.split(", ")]


def to_row(m: Model, score: float, rounds: int) -> dict:
    flat = {c: None if (v := getattr(m, c)) is None else np.asarray(v, float).ravel().tolist() for c in _ARRAYS}
    return {"states": m.k, **flat, "score": score, "rounds": rounds, "skipped": None}


def from_row(row, features: int) -> Model:
    k = int(row["states"])
    shape = {"pi": (k,), "a": (k, k), "mu": (k, features), "var": (k, features), "nu": (k,), "dur": (k, -1)}
    return Model(**{c: None if row[c] is None else np.asarray(row[c], float).reshape(shape[c]) for c in _ARRAYS})


def fit_starts(x: np.ndarray, kind: str, states: int, seeds: list[int], most: int = 30, price: float = 1.0) -> list[tuple[Model, float, int]]:
    """One kind of model from each of several starts; the score is larger for better fits."""
    if kind == "jump":
        found = [jump.fit_jump(x, states, price, s) for s in seeds]
        return [(jump.as_model(x, centers, path), -total, 1) for centers, path, total in found]
    student = kind.startswith("student")
    if kind.endswith("hsmm"):
        return semi.fit_semi_starts(x, states, most, seeds, student=student)
    return chain.fit_starts(x, states, seeds, student=student)


def best_fit(x: np.ndarray, kind: str, states: int, seeds: list[int], **options) -> tuple[Model, float, int]:
    return max(fit_starts(x, kind, states, seeds, **options), key=lambda f: f[1])


def predict(m: Model, x: np.ndarray, kind: str, price: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs of each row, and of the next one, from rows up to it."""
    if kind == "jump":
        now = np.eye(m.k)[jump.online(jump.losses(x, m.mu), price)]
        return now, now
    return (semi if m.dur is not None else chain).predictions(m, x)


def _failed(reason: str) -> dict:
    return dict.fromkeys(_MODEL_NAMES) | {"skipped": reason}


def fit_models(features: DataFrame, names: list[str], kind: str = "hmm", states: int = 3, restarts: int = 4, seed: int = 42, keys: tuple[str, ...] = ("series",), **options) -> DataFrame:
    """The best of ``restarts`` starts for each key: a model row, or one whose ``skipped`` says why there is none.

    The starts of a key share its rows and go side by side in one task. Markov chains of series of more than ``LONG`` rows are
    fitted over blocks instead, so that no task holds a long series.
    """
    if kind in ("hmm", "student") and keys == ("series",) and not options:
        sizes = features.groupBy("series").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG).select("series")
        long = [r["series"] for r in sizes.limit(LONG_SERIES + 1).collect()]  # names alone, and few
        if long:
            split = settled(sizes) if len(long) > LONG_SERIES else features.sparkSession.createDataFrame([(n,) for n in long], "series string")
            short = features.join(F.broadcast(split) if len(long) <= LONG_SERIES else split, "series", "left_anti")
            rest = features.join(F.broadcast(split) if len(long) <= LONG_SERIES else split, "series", "left_semi")
            each = [blocked.fit_long(rest, names, states, seed + 7919 * s, student=kind == "student") for s in range(restarts)]
            fitted = reduce(DataFrame.unionByName, each).groupBy("series", "kind").agg(F.max_by(F.struct(*_MODEL_NAMES), "score").alias("m"))
            return fit_short(short, names, kind, states, restarts, seed).unionByName(fitted.select("series", "kind", "m.*"))
    return fit_short(features, names, kind, states, restarts, seed, keys, **options)


def fit_short(features: DataFrame, names: list[str], kind: str, states: int, restarts: int, seed: int, keys: tuple[str, ...] = ("series",), **options) -> DataFrame:
    """:func:`fit_models` of keys of any number but of moderate length: one task a key."""
    seeds = [seed + 7919 * s for s in range(restarts)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("row")[names].to_numpy(float)
        try:
            found = to_row(*best_fit(x, kind, states, seeds, **options))
        except ValueError as e:
            found = _failed(str(e))
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, **found}], columns=[*keys, *_MODEL_NAMES])

    types = ", ".join(f"{k} {features.schema[k].dataType.simpleString()}" for k in keys)
    best = features.select(*keys, "row", *names).groupBy(*keys).applyInPandas(run, f"{types}, {_MODEL}")
    return best.select(*keys, F.lit(kind).alias("kind"), *_MODEL_NAMES)


def _per_group(features: DataFrame, models: DataFrame, names: list[str], run: Callable, schema: str) -> DataFrame:
    """Features of each series beside its model, one group a series."""
    return features.groupBy("series").cogroup(models.groupBy("series")).applyInPandas(run, schema)


def beliefs(features: DataFrame, models: DataFrame, names: list[str], kind: str = "hmm") -> DataFrame:
    """series, row, state (likeliest now), now and ahead: filtered probabilities of each row and of the next.

    Markov chains go by blocks of rows, so a long series is many tasks; the others have a task a series.
    """
    if kind in ("hmm", "student"):
        return blocked.beliefs(features, models, names)

    def run(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(model) or model["skipped"].iloc[0] is not None:
            return pd.DataFrame(columns=["series", "row", "state", "now", "ahead"])
        rows = rows.sort_values("row")
        now, ahead = predict(from_row(model.iloc[0], len(names)), rows[names].to_numpy(float), kind)
        return pd.DataFrame({"series": rows["series"], "row": rows["row"], "state": now.argmax(1), "now": now.tolist(), "ahead": ahead.tolist()})

    return _per_group(features.select("series", "row", *names), models, names, run, "series string, row long, state int, now array<double>, ahead array<double>")


def decoded(features: DataFrame, models: DataFrame, names: list[str], kind: str = "hmm") -> DataFrame:
    """series, row and state of the likeliest path of all rows; it looks ahead, so it is for display. Markov chains go by blocks."""
    if kind in ("hmm", "student"):
        return blocked.decoded(features, models, names)

    def run(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(model) or model["skipped"].iloc[0] is not None:
            return pd.DataFrame(columns=["series", "row", "state"])
        rows, m = rows.sort_values("row"), from_row(model.iloc[0], len(names))
        path = (semi if m.dur is not None else chain).viterbi(m, rows[names].to_numpy(float))
        return pd.DataFrame({"series": rows["series"], "row": rows["row"], "state": path})

    return _per_group(features.select("series", "row", *names), models, names, run, "series string, row long, state int")


def state_units(models: DataFrame, scaler: DataFrame, names: list[str]) -> DataFrame:
    """series, state, mean_return and volatility of the states of saved models in their own units, as columns alone."""
    width, at = len(names), names.index("realized_vol") if "realized_vol" in names else None
    states = models.where("skipped is null").join(scaler, "series").withColumn("state", F.explode(F.sequence(F.lit(0), F.col("states") - 1)))
    of = lambda i: unscaled(F.get("mu", F.col("state") * width + i), names[i])
    vol = F.lit(None).cast("double") if at is None else F.exp(of(at))
    return states.select("series", "state", of(0).alias("mean_return"), vol.alias("volatility"))


# --- walk-forward -------------------------------------------------------------------------------------------------


def blocks(features: DataFrame, train: int, test: int, expanding: bool = False) -> DataFrame:
    """Rows of each block, with block, begin and split (first test row). Too short a series has none.

    Training starts every ``test`` rows; the last block takes a rest that is shorter than half a block. Each row goes
    only to the blocks that use it. ``expanding``: training begins with the series.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("series"))
    rows = features.withColumn("_n", size).where(F.col("_n") >= train + test + 2)
    last = F.greatest(F.floor((F.col("_n") - train - 1.5 * test) / test) + 1, F.lit(0))
    rows = rows.withColumn("_last", last)
    first = F.least(F.col("_last"), F.greatest(F.ceil((F.col("row") - train - test + 1) / test), F.lit(0)))
    most = F.col("_last") if expanding else F.least(F.col("_last"), F.floor(F.col("row") / test))
    rows = rows.where(first <= most).withColumn("block", F.explode(F.sequence(first, most)))
    end = F.when(F.col("block") == F.col("_last"), F.col("_n")).otherwise(F.col("block") * test + train + test)
    begin = F.lit(0) if expanding else F.col("block") * test
    rows = rows.withColumns({"begin": begin, "split": F.col("block") * test + train})
    return rows.where((F.col("row") >= F.col("begin")) & (F.col("row") < end)).drop("_n", "_last")


def fitted(raw: np.ndarray, learn: np.ndarray, names: list[str], kind: str, states: int, seeds: list[int], options: dict):
    """The best start on the rows to learn from: model, beliefs of the next row, and means and volatilities of states in
    their own units; or why there is none."""
    mean, sd = raw[learn].mean(0), np.maximum(raw[learn].std(0), 1e-12)
    x = (raw - mean) / sd
    try:
        m = best_fit(x[learn], kind, states, seeds, **options)[0]
    except ValueError as e:
        return str(e)
    _, ahead = predict(m, x, kind, options.get("price", 1.0))
    at = names.index("realized_vol") if "realized_vol" in names else None
    vols = np.zeros(m.k) if at is None else np.exp(m.mu[:, at] * sd[at] + mean[at])
    return m, ahead, m.mu[:, 0] * sd[0] + mean[0], vols


def walk_forward(features: DataFrame, names: list[str], kind: str = "hmm", states: int = 3, train: int = 1500, test: int = 500, seed: int = 42, restarts: int = 4, expanding: bool = False, **options) -> DataFrame:
    """Causal forecasts of the test rows of all blocks: series, block, row, expected, volatility, top, hold and probs.

    Scaler and model see the training rows of their block only; the belief runs from them into the test rows. Blocks are
    tasks of their own. Test rows of a block that cannot be fitted expect nothing, and ``skipped`` says why.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        learn, block = (rows["row"] < rows["split"]).to_numpy(), int(rows["block"].iloc[0])
        done = fitted(rows[names].to_numpy(float), learn, names, kind, states, [seed + block + 7919 * k for k in range(restarts)], options)
        out = rows.loc[~learn, ["series", "block", "row"]].copy()
        if isinstance(done, str):
            return out.assign(expected=0.0, volatility=0.0, top=0.0, hold=1.0, probs=None, skipped=done)
        m, ahead, means, vols = done
        ahead = ahead[~learn]
        hold = float(min(chain.expected_durations(m)[-1], 1e9))
        return out.assign(expected=ahead @ means, volatility=ahead @ vols, top=ahead[:, -1], hold=hold, probs=ahead.tolist(), skipped=None)

    placed = blocks(features, train, test, expanding).select("series", "block", "row", "split", *names)
    return placed.groupBy("series", "block").applyInPandas(run, _FORECAST)


_FORECAST = "series string, block long, row long, expected double, volatility double, top double, hold double, probs array<double>, skipped string"


# --- posteriors ---------------------------------------------------------------------------------------------------


def posterior_draws(features: DataFrame, names: list[str], engine: str = "vb", states: int = 3, draws: int = 1000, seed: int = 11, most: int = 30, chains: int = 1, rounds: int = 400) -> DataFrame:
    """One row a draw: series, draw, means (of feature 0, in its own units), dwell and the bound of the fit.

    Engines: ``vb``, ``vb_hsmm`` and ``gibbs``.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        raw = rows[names].to_numpy(float)
        mean, sd = raw.mean(0), np.maximum(raw.std(0), 1e-12)  # in sample, as it describes the sample
        x, seeds = (raw - mean) / sd, [seed + 7919 * c for c in range(chains)]
        try:
            starts = semi.fit_semi_starts(x, states, most, seeds) if engine == "vb_hsmm" else chain.fit_starts(x, states, seeds)
        except ValueError:
            return pd.DataFrame(columns=[c.split()[0] for c in _DRAWS.split(", ")])
        starts = [m for m, _, _ in starts]
        if engine == "gibbs":  # chains share the rows and go side by side
            found = [(ms, None) for ms in bayes.gibbs_chains(x, states, starts, seeds, rounds)]
        else:
            found = []
            for own, start in zip(seeds, starts):
                q, bounds, _ = bayes.fit_vb(x, states, start)
                rng = np.random.default_rng(own)
                found.append(([bayes.draw(q, rng) for _ in range(draws)], bounds[-1] / len(x)))
        each = [
            pd.DataFrame(
                {
                    "series": rows["series"].iloc[0],
                    "chain": c,
                    "draw": np.arange(len(models)),
                    "means": [(m.mu[:, 0] * sd[0] + mean[0]).tolist() for m in models],
                    "dwell": [np.minimum(chain.expected_durations(m), 1e9).tolist() for m in models],
                    "bound": bound,
                }
            )
            for c, (models, bound) in enumerate(found)
        ]
        return pd.concat(each)

    return features.select("series", "row", *names).groupBy("series").applyInPandas(run, _DRAWS)


_DRAWS = "series string, chain int, draw int, means array<double>, dwell array<double>, bound double"


def interval(value, credible: float = 0.9) -> list:
    """mean, low, high and the share above 0 of a column over the draws of a group, whose number is a parameter."""
    tail = (1 - credible) / 2
    sorted_values = F.array_sort(F.collect_list(value))
    at = lambda f: F.element_at(sorted_values, (F.least(F.floor(f * F.size(sorted_values)), F.size(sorted_values) - 1) + 1).cast("int"))
    return [F.avg(value).alias("mean"), at(tail).alias("low"), at(1 - tail).alias("high"), F.avg((F.col(value) > 0).cast("double")).alias("p_positive")]


def state_intervals(draws: DataFrame, column: str, credible: float = 0.9) -> DataFrame:
    """Intervals of each state of each series."""
    long = draws.select("series", F.posexplode(column).alias("state", "value"))
    return long.groupBy("series", "state").agg(*interval("value", credible))


def signal_interval(draws: DataFrame, now: DataFrame, cost: float, credible: float = 0.9) -> DataFrame:
    """What a trade of the best state earns, drawn with its dwell: ``now`` has series and probs, the belief at hand."""
    each = draws.join(now, "series").withColumn("bar", F.aggregate(F.zip_with("probs", "means", lambda p, m: p * m), F.lit(0.0), lambda a, x: a + x))
    each = each.withColumn("hold", F.element_at("dwell", -1)).withColumn("trade", F.col("bar") * F.col("hold"))
    holds = F.array_sort(F.collect_list("hold"))
    return each.groupBy("series").agg(
        *interval("trade", credible), F.element_at(holds, (F.floor(F.size(holds) / 2) + 1).cast("int")).alias("median_hold"), F.avg((F.col("trade") > cost).cast("double")).alias("p_above_cost"),
    )


def select_states(features: DataFrame, names: list[str], candidates: tuple[int, ...] = (2, 3, 4, 5), seed: int = 20240, lasting: bool = False, most: int = 30) -> DataFrame:
    """The bound of a variational fit for each number of states, how many are occupied, and which is best."""
    rows = features.select("series", "row", *names).withColumn("states", F.explode(F.array(*map(F.lit, candidates))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["states"].iloc[0])
        x = group.sort_values("row")[names].to_numpy(float)
        x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
        if len(x) < 10 * k:
            return pd.DataFrame(columns=["series", "states", "bound", "occupied", "rounds"])
        start = (semi.fit_semi(x, k, most, seed) if lasting else chain.fit(x, k, seed))[0]
        _, bounds, weight = bayes.fit_vb(x, k, start)
        return pd.DataFrame({"series": group["series"].iloc[:1], "states": k, "bound": bounds[-1] / len(x), "occupied": int((weight > 0.01 * len(x)).sum()), "rounds": len(bounds)})

    found = rows.groupBy("series", "states").applyInPandas(run, "series string, states int, bound double, occupied int, rounds int")
    return found.withColumn("best", F.row_number().over(Window.partitionBy("series").orderBy(F.col("bound").desc(), "states")) == 1)


def best_assignment(counts: np.ndarray) -> int:
    """The largest sum of entries with one in each row and column: by sets of columns, row after row, so 2**K sums for K states."""
    k = len(counts)
    masks = np.arange(1 << k)
    best = np.full(1 << k, -1)
    best[0] = 0
    for row in counts:
        after = np.full(1 << k, -1)
        for col in range(k):
            free = masks[((masks >> col) & 1 == 0) & (best >= 0)]
            np.maximum.at(after, free | (1 << col), best[free] + row[col])
        best = after
    return int(best[-1])


def best_relabelling(pairs: DataFrame, states: int) -> DataFrame:
    """Accuracy of each series' path against the truth under the best naming of states: from a table of counts."""
    counts = pairs.groupBy("series", "state", "truth").agg(F.count(F.lit(1)).alias("n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((states, states), np.int64)
        table[rows["state"], rows["truth"]] = rows["n"]
        return pd.DataFrame({"series": rows["series"].iloc[:1], "accuracy": [best_assignment(table) / table.sum()]})

    return counts.groupBy("series").applyInPandas(run, "series string, accuracy double")  # K * K rows a series


def occupancy(path: DataFrame) -> DataFrame:
    """Rows, share, runs and mean run length of each state of each series."""
    w = Window.partitionBy("series").orderBy("row")
    starts = path.withColumn("new", F.coalesce(F.col("state") != F.lag("state").over(w), F.lit(True)).cast("int"))
    rows = starts.groupBy("series", "state").agg(F.count(F.lit(1)).alias("rows"), F.sum("new").alias("runs"))
    total = F.sum("rows").over(Window.partitionBy("series"))
    return rows.select("series", "state", "rows", "runs", (F.col("rows") / total).alias("share"), (F.col("rows") / F.col("runs")).alias("mean_run"))
