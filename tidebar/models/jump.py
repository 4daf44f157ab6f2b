"""The jump model: each row in the state of the nearest centre, at a price for each change of state."""

from __future__ import annotations

import numpy as np

from .chain import Model, seeded_centers


def losses(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((x[:, None] - centers) ** 2).sum(2)


def objective(loss: np.ndarray, path: np.ndarray, price: float) -> float:
    return float(loss[np.arange(len(path)), path].sum() + price * (np.diff(path) != 0).sum())


def cheapest_path(loss: np.ndarray, price: float) -> np.ndarray:
    """Least total of losses and changes; on a tie it stays."""
    value, back = loss[0].copy(), np.zeros(loss.shape, int)
    own = np.arange(loss.shape[1])
    for t in range(1, len(loss)):
        best = int(value.argmin())
        moves = value[best] + price < value
        back[t] = np.where(moves, best, own)
        value = np.minimum(value, value[best] + price) + loss[t]
    path = np.empty(len(loss), int)
    path[-1] = value.argmin()
    for t in range(len(loss) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def online(loss: np.ndarray, price: float, state: int | None = None) -> np.ndarray:
    """State of each row from rows up to it: the one that is cheapest to have arrived in."""
    value = np.zeros(loss.shape[1]) if state is None else np.where(np.arange(loss.shape[1]) == state, 0.0, price)
    out = np.empty(len(loss), int)
    for t in range(len(loss)):
        value = loss[t] + np.minimum(value, value.min() + price)
        value -= value.min()
        out[t] = value.argmin()
    return out


def belief_step(m: Model, x: np.ndarray, state: np.ndarray | None, price: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One more row of :func:`online`. The state is the least cost of having arrived in each state, from the cheapest on."""
    value = np.zeros(m.k) if state is None else state
    value = losses(x[None], m.mu)[0] + np.minimum(value, value.min() + price)
    value = value - value.min()
    now = np.eye(m.k)[int(value.argmin())]
    return value, now, now


def fit_jump(x: np.ndarray, k: int = 3, price: float = 1.0, seed: int = 42, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """One start: centres in ascending order of feature 0, path and objective."""
    if len(x) < k:
        raise ValueError(f"{k} states need as many rows")
    centers, _ = seeded_centers(x, k, np.random.default_rng(seed))
    best, path = np.inf, None
    for _ in range(rounds):
        new = cheapest_path(losses(x, centers), price)
        moved = np.array([x[new == j].mean(0) if (new == j).any() else centers[j] for j in range(k)])
        total = objective(losses(x, moved), new, price)
        if total >= best - 1e-12:
            break
        best, path, centers = total, new, moved
    order = np.argsort(centers[:, 0], kind="stable")
    return centers[order], np.argsort(order)[path], best


def as_model(x: np.ndarray, centers: np.ndarray, path: np.ndarray) -> Model:
    """A chain with the path's counts, for what reads means, durations and moves of a chain."""
    k = len(centers)
    count = np.bincount(path, minlength=k)
    a = np.zeros((k, k))
    np.add.at(a, (path[:-1], path[1:]), 1)
    seen = a.sum(1, keepdims=True)
    a = np.where(seen > 0, a / np.where(seen > 0, seen, 1), np.eye(k))
    var = np.array([np.maximum(((x[path == j] - centers[j]) ** 2).mean(0), 1e-8) if count[j] > 1 else np.ones(x.shape[1]) for j in range(k)])
    return Model(count / count.sum(), a, centers, var)


def run_lengths(path: np.ndarray, k: int) -> np.ndarray:
    """Mean length of each state's runs, 1 if it has none."""
    edge = np.flatnonzero(np.diff(path)) + 1
    starts, ends = np.append(0, edge), np.append(edge, len(path))
    runs, length = np.bincount(path[starts], minlength=k), np.bincount(path[starts], weights=ends - starts, minlength=k)
    return np.where(runs > 0, length / np.maximum(runs, 1), 1.0)
