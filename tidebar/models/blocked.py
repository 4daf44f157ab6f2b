"""Regime models over series of any length: each series is cut into blocks of rows, and no task holds more than blocks.

A block is reduced to one K x K matrix (of probabilities, or of least costs), the matrices of a series are composed over one row
a block, and each block is finished from what is carried to it. Fits do the same every round: a block adds up what the next
model needs (weights, sums, squares, moves), and a groupBy adds up the blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import digamma
from ..session import settled
from . import chain, scan
from .chain import Model

#: Rows of a block, and rounds of a fit over blocks (each is one job).
BLOCK, ROUNDS = 4096, 50
_PACKED = "series string, block long, first long, rows int, data binary"


def packed(features: DataFrame, names: list[str], size: int | None = None) -> DataFrame:
    """series, block, first row, number of rows and the rows' features as one binary matrix: one row a block."""
    size = size or BLOCK

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        data = rows[names].to_numpy(np.float64).tobytes()
        return pd.DataFrame({"series": rows["series"].iloc[:1], "block": rows["block"].iloc[:1], "first": rows["row"].iloc[:1], "rows": [len(rows)], "data": [data]})

    placed = features.select("series", F.floor(F.col("row") / size).alias("block"), F.col("row").cast("long").alias("row"), *names)
    return placed.groupBy("series", "block").applyInPandas(run, _PACKED)


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.float64).reshape(row["rows"], -1)


def _each(blocks: DataFrame, run: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """A frame of ``run`` of each row, a block at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def mapped(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                found = run(row)
                if found is not None:
                    yield pd.DataFrame(found)[names]

    return blocks.mapInPandas(mapped, schema)


def _with_models(blocks: DataFrame, models: DataFrame) -> DataFrame:
    """Blocks beside the model of their series; series without one are left out."""
    keep = ["states", "pi", "a", "mu", "var", "nu"]
    return blocks.join(models.where(F.col("skipped").isNull()).select("series", *keep), "series")


def _model(row: dict) -> Model:
    k = int(row["states"])
    shape = {"pi": (k,), "a": (k, k), "mu": (k, -1), "var": (k, -1), "nu": (k,)}
    return Model(**{c: None if row[c] is None else np.asarray(row[c], float).reshape(s) for c, s in shape.items()})


def _emissions(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions of each row in units of the largest, as a batch of one, and the logs of those."""
    log_b = chain.log_emissions(m, x)
    top = log_b.max(1)
    return np.exp(log_b - top[:, None])[None], top


_CARRIED = "series string, block long, last array<double>, ahead array<double>, after array<double>"


def carried(blocks: DataFrame, models: DataFrame) -> DataFrame:
    """series, block, last (the belief of the row before a block, null for the first), ahead (what it leads to, with which the
    block begins) and after (what all later blocks say of its last state)."""

    def reduce(row: dict) -> dict:
        m = _model(row)
        b, _ = _emissions(m, _matrix(row))
        cells, rest, _ = scan.cut(b)
        q = scan.products(cells, rest, m.a[None])
        whole = q[:, 0]
        for i in range(1, q.shape[1]):
            whole = whole @ m.a[None] @ q[:, i]
            whole /= whole.max()
        return {"series": [row["series"]], "block": [row["block"]], "q": [whole.ravel()], "pi": [m.pi], "a": [m.a.ravel()]}

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        pi = np.array(rows["pi"].iloc[0])[None]
        k = pi.shape[1]
        a, q = np.array(rows["a"].iloc[0]).reshape(1, k, k), np.stack(rows["q"].to_list()).reshape(1, -1, k, k)
        ahead = scan.openings(q, pi, a)
        own = (ahead[:, :, None] @ q)[0, :, 0]
        last = [None, *(own / own.sum(1, keepdims=True))[:-1]]
        return pd.DataFrame({"series": rows["series"], "block": rows["block"], "last": last, "ahead": list(ahead[0]), "after": list(scan.closings(q, a)[0])})

    reduced = _each(_with_models(blocks, models), reduce, "series string, block long, q array<double>, pi array<double>, a array<double>")
    return reduced.groupBy("series").applyInPandas(compose, _CARRIED)


def beliefs(features: DataFrame, models: DataFrame, names: list[str]) -> DataFrame:
    """series, row, state (likeliest now), now and ahead: filtered probabilities of each row and of the next, of Markov models."""
    blocks = packed(features, names)

    def finish(row: dict) -> dict:
        m, x = _model(row), _matrix(row)
        cells, rest, _ = scan.cut(_emissions(m, x)[0])
        ahead = np.array(row["ahead"])[None]
        alpha, _ = scan.filtered(cells, scan.openings(scan.products(cells, rest, m.a[None]), ahead, m.a[None]), m.a[None])
        now = alpha.reshape(-1, m.k)[: len(x)]
        return {"series": row["series"], "row": row["first"] + np.arange(len(x)), "state": now.argmax(1), "now": list(now), "ahead": list(now @ m.a)}

    ready = _with_models(blocks, models).join(carried(blocks, models), ["series", "block"])
    return _each(ready, finish, "series string, row long, state int, now array<double>, ahead array<double>")


# --- cheapest paths -----------------------------------------------------------------------------------------------


def _costs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost of each row in each state, of each move, and of each first state, of a Markov model's likeliest path."""
    m = _model(row)
    log = lambda p: -np.log(np.maximum(p, 1e-300))
    return -chain.log_emissions(m, _matrix(row)), log(m.a), log(m.pi)


def paths(blocks: DataFrame, costs: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """series, row and state of the cheapest path of each series; of equal ones the lower state.

    Blocks are reduced to least costs between the states at their edges; the states at the edges are chosen over one row a
    block; then each block finds its own path between them.
    """

    def reduce(row: dict) -> dict:
        cost, price, first = costs(row)
        return {"series": [row["series"]], "block": [row["block"]], "w": [scan.cheapest(cost, price).ravel()], "start": [first + cost[0]], "w1": [(scan.cheapest(cost[1:], price) if len(cost) > 1 else _still(len(first))).ravel()]}

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        k = len(rows["start"].iloc[0])
        w = np.stack(rows["w"].to_list()).reshape(-1, k, k)
        own = (np.array(rows["start"].iloc[0])[:, None] + np.array(rows["w1"].iloc[0]).reshape(k, k)).min(0)
        value = [own]
        for i in range(1, len(w)):
            value.append((value[-1][:, None] + w[i]).min(0))
        ends = np.empty(len(w), int)
        ends[-1] = value[-1].argmin()
        for i in range(len(w) - 1, 0, -1):
            ends[i - 1] = (value[i - 1] + w[i][:, ends[i]]).argmin()
        return pd.DataFrame({"series": rows["series"], "block": rows["block"], "before": np.append(-1, ends[:-1]), "end": ends})

    def finish(row: dict) -> dict:
        cost, price, first = costs(row)
        value = cost[0] + (first if row["before"] < 0 else price[int(row["before"])])
        back = np.zeros(cost.shape, int)
        for t in range(1, len(cost)):
            options = value[:, None] + price
            back[t] = options.argmin(0)
            value = options.min(0) + cost[t]
        path = np.empty(len(cost), int)
        path[-1] = row["end"]
        for t in range(len(cost) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return {"series": row["series"], "row": row["first"] + np.arange(len(path)), "state": path}

    reduced = _each(blocks, reduce, "series string, block long, w array<double>, start array<double>, w1 array<double>")
    edges = reduced.groupBy("series").applyInPandas(compose, "series string, block long, before int, end int")
    return _each(blocks.join(edges, ["series", "block"]), finish, "series string, row long, state int")


def _still(k: int) -> np.ndarray:
    return np.where(np.eye(k, dtype=bool), 0.0, np.inf)


def decoded(features: DataFrame, models: DataFrame, names: list[str]) -> DataFrame:
    """series, row and state of the likeliest path under Markov models."""
    return paths(_with_models(packed(features, names), models), _costs)


def arrived(features: DataFrame, names: list[str], centers: np.ndarray, price: float) -> DataFrame:
    """series, row and state of the jump model, each from rows up to it: the state that is cheapest to have arrived in."""
    k = len(centers)
    move = np.where(np.eye(k, dtype=bool), 0.0, price)
    blocks = packed(features, names)

    def loss(row: dict) -> np.ndarray:
        return ((_matrix(row)[:, None] - centers) ** 2).sum(2)

    def reduce(row: dict) -> dict:
        return {"series": [row["series"]], "block": [row["block"]], "w": [scan.cheapest(loss(row), move).ravel()]}

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        value, out = np.zeros(k), []
        for w in rows["w"]:
            out.append(value)
            value = (value[:, None] + np.reshape(w, (k, k))).min(0)
            value = value - value.min()
        return pd.DataFrame({"series": rows["series"], "block": rows["block"], "value": out})

    def finish(row: dict) -> dict:
        own, value = loss(row), np.array(row["value"])
        state = np.empty(len(own), int)
        for t in range(len(own)):
            value = own[t] + np.minimum(value, value.min() + price)
            value -= value.min()
            state[t] = value.argmin()
        return {"series": row["series"], "row": row["first"] + np.arange(len(own)), "state": state}

    edges = _each(blocks, reduce, "series string, block long, w array<double>").groupBy("series").applyInPandas(compose, "series string, block long, value array<double>")
    return _each(blocks.join(edges, ["series", "block"]), finish, "series string, row long, state int")


# --- fits ---------------------------------------------------------------------------------------------------------

_SUMS = "series string, block long, sums array<double>, total double"


def _statistics(blocks: DataFrame, models: DataFrame) -> DataFrame:
    """What the next model needs, added up in each block: moves, weights, sums and squares, heavy tails' terms, first states."""

    def run(row: dict) -> dict:
        m, x = _model(row), _matrix(row)
        b, top = _emissions(m, x)
        cells, rest, _ = scan.cut(b)
        a = m.a[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            q = scan.products(cells, rest, a)
            alpha, scale = scan.filtered(cells, scan.openings(q, np.array(row["ahead"])[None], a), a)
            beta = scan.followed(cells, rest, scan.closings(q, a, np.array(row["after"])[None]), a)
            alpha, scale, beta = (v.reshape(1, -1, *v.shape[3:])[:, : len(x)] for v in (alpha, scale, beta))
            gamma = scan.weights(alpha, beta)[0]
            before = alpha[:, :-1] if row["last"] is None else np.concatenate([np.array(row["last"])[None, None], alpha[:, :-1]], 1)
            moves = scan.moves(before, (b * beta)[:, -before.shape[1] :], a)[0] if before.shape[1] else np.zeros(m.a.shape)
            total = top.sum() + np.log(scale).sum()
        u = np.ones_like(gamma) if m.nu is None else (m.nu + x.shape[1]) / (m.nu + chain.distances(m, x))
        w = gamma * u
        own = [moves, gamma.sum(0), w.sum(0), w.T @ x, w.T @ (x * x), (gamma * (np.log(u) - u)).sum(0), gamma[0] if row["last"] is None else np.zeros(m.k)]
        return {"series": [row["series"]], "block": [row["block"]], "sums": [np.concatenate([np.ravel(v) for v in own])], "total": [total]}

    ready = _with_models(blocks, models).join(carried(blocks, models), ["series", "block"])
    return _each(ready, run, _SUMS)


def _next_model(m: Model, sums: np.ndarray, features: int, floor: float, prior: float) -> Model:
    k = m.k
    sizes = np.cumsum([k * k, k, k, k * features, k * features, k])
    moves, weight, pull, first, second, tail, start = np.split(sums, sizes)
    moves, first, second = moves.reshape(k, k) + prior, first.reshape(k, -1), second.reshape(k, -1)
    alive = weight > 1e-8
    safe = np.where(alive, pull, 1)[:, None]
    mu = np.where(alive[:, None], first / safe, m.mu)
    apart = second - 2 * mu * first + mu * mu * pull[:, None]
    var = np.where(alive[:, None], np.maximum(apart / np.where(alive, weight, 1)[:, None], floor), m.var)
    nu = m.nu
    if nu is not None:
        nu = np.array([_nu(tail[j] / weight[j], nu[j], features) if alive[j] else nu[j] for j in range(k)])
    return replace(m, pi=start / start.sum(), a=moves / moves.sum(1, keepdims=True), mu=mu, var=var, nu=nu)


def _nu(tail: float, old: float, width: int) -> float:
    """Degrees of freedom from the mean of log u - u: the root of the expected score at the model that gave the weights."""
    known = 1 + tail + digamma((old + width) / 2) - np.log((old + width) / 2)
    score = lambda v: np.log(v / 2) - digamma(v / 2) + known
    low, high = chain.LEAST_NU, chain.MOST_NU
    if score(low) <= 0:
        return low
    if score(high) >= 0:
        return high
    while high - low > 1e-6 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if score(middle) > 0 else (low, middle)
    return (low + high) / 2


_MODELS = "series string, states int, pi array<double>, a array<double>, mu array<double>, var array<double>, nu array<double>, score double, gain double, rounds int, skipped string"


def one_round(blocks: DataFrame, models: DataFrame, features: int, floor: float = 1e-8, prior: float = 0.1) -> DataFrame:
    """The models after one round over all blocks; score is the log likelihood of the model that went in."""
    found = _statistics(blocks, models)
    each = found.select("series", "total", F.posexplode("sums").alias("at", "value"))
    sums = each.groupBy("series", "at").agg(F.sum("value").alias("value"))  # a row for each block, task and place is added up in the tasks
    whole = sums.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("sums"))
    totals = found.groupBy("series").agg(F.sum("total").alias("total"))
    joined = models.join(whole, "series", "left").join(totals, "series", "left")

    def run(row: dict) -> dict:
        out = {c.split()[0]: [row[c.split()[0]]] for c in _MODELS.split(", ")}
        if row["skipped"] is None:
            m = _next_model(_model(row), np.array(row["sums"]), features, floor, prior)
            arrays = {c: [None if (v := getattr(m, c)) is None else np.ravel(v)] for c in ("pi", "a", "mu", "var", "nu")}
            out |= {**arrays, "gain": [row["total"] - row["score"]], "score": [row["total"]], "rounds": [row["rounds"] + 1]}
        return out

    return _each(joined, run, _MODELS)


def first_models(blocks: DataFrame, sizes: DataFrame, k: int, seed: int, floor: float, student: bool) -> DataFrame:
    """A first guess for each series, from one of its blocks, the same for the same series and seed."""

    def run(row: dict) -> dict:
        found = {c.split()[0]: [None] for c in _MODELS.split(", ")} | {"series": [row["series"]], "states": [k], "rounds": [0], "score": [-np.inf], "gain": [np.inf]}
        if row["n"] < 10 * k:
            return found | {"skipped": [f"{k} states need {10 * k} rows, there are {row['n']}"]}
        m = chain.first_guess(_matrix(row), k, np.random.default_rng(seed), floor, student)
        return found | {c: [None if (v := getattr(m, c)) is None else np.ravel(v)] for c in ("pi", "a", "mu", "var", "nu")}

    # one that is no rest, and one that another seed would not choose
    order = Window.partitionBy("series").orderBy(F.col("rows") * 2 < F.least("n", F.lit(BLOCK)), F.xxhash64(F.lit(seed), "block"))
    return _each(blocks.join(sizes, "series").withColumn("place", F.row_number().over(order)).where("place = 1"), run, _MODELS)


def fit_long(features: DataFrame, names: list[str], states: int = 3, seed: int = 42, rounds: int | None = None, tol: float = 1e-6, floor: float = 1e-8, prior: float = 0.1, student: bool = False) -> DataFrame:
    """A Markov model of each series by expectation maximisation over blocks: as rows of :func:`.grouped.fit_models`.

    Every round is one job over all blocks of all series; the sums of a series are a few dozen numbers. Rounds end when no series
    gains more than ``tol`` a row. The first guess is made from one block of the series.
    """
    blocks = settled(packed(features, names))
    sizes = settled(blocks.groupBy("series").agg(F.sum("rows").alias("n")))
    models = settled(first_models(blocks, sizes, states, seed, floor, student))
    for _ in range(rounds or ROUNDS):
        models = settled(one_round(blocks, models, len(names), floor, prior))
        if not models.join(sizes, "series").where(F.col("skipped").isNull() & (F.col("gain") > tol * F.col("n"))).limit(1).count():
            break
    columns = [c.split()[0] for c in _MODELS.split(", ") if c.split()[0] not in ("series", "gain", "score", "rounds", "skipped")]
    done = models.select("series", F.lit("student" if student else "hmm").alias("kind"), *columns, F.lit(None).cast("array<double>").alias("dur"), "score", "rounds", "skipped")
    return done
