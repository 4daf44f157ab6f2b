"""Hidden Markov chains: emissions, filtering, smoothing, decoding and expectation maximisation."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from ..functions.special import digamma, lgamma
from . import scan

LEAST_NU, MOST_NU = 2.02, 200.0


@dataclass(frozen=True)
class Model:
    """States in ascending order of the mean of feature 0. ``nu`` marks Student-t emissions (``var`` is then their scale)."""

    pi: np.ndarray
    a: np.ndarray
    mu: np.ndarray
    var: np.ndarray
    nu: np.ndarray | None = None
    dur: np.ndarray | None = None  # (state, duration), from 1: a semi-Markov chain

    @property
    def k(self) -> int:
        return len(self.pi)

    def sorted(self) -> Model:
        o = np.argsort(self.mu[:, 0], kind="stable")
        pick = lambda x: None if x is None else x[o]
        return Model(self.pi[o], self.a[np.ix_(o, o)], self.mu[o], self.var[o], pick(self.nu), pick(self.dur))


def distances(m: Model, x: np.ndarray) -> np.ndarray:
    """(row, state): squared distance in units of the scale."""
    return ((x[:, None, :] - m.mu) ** 2 / m.var).sum(2)


def log_emissions(m: Model, x: np.ndarray) -> np.ndarray:
    d, width = distances(m, x), x.shape[1]
    spread = np.log(m.var).sum(1)
    if m.nu is None:
        return -0.5 * (width * np.log(2 * np.pi) + spread + d)
    half = (m.nu + width) / 2
    norm = lgamma(half) - lgamma(m.nu / 2) - width / 2 * np.log(m.nu * np.pi) - 0.5 * spread
    return norm - half * np.log1p(d / m.nu)


def forward(log_b: np.ndarray, pi: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, float]:
    """Filtered probabilities (row, state), each from its own and earlier rows only, and the log likelihood.

    A row that no state can explain makes the belief uniform. ``pi`` and ``a`` need not sum to one.
    """
    top = log_b.max(1)
    b = np.exp(log_b - top[:, None])
    alpha, scale, ahead = np.empty_like(b), [], pi
    for t in range(len(b)):
        own = b[t] * ahead
        s = float(own.sum())
        if 0 < s < np.inf:
            own /= s
        else:
            own, s = np.full(len(pi), 1 / len(pi)), 1.0
        scale.append(s)
        alpha[t] = own
        ahead = own @ a
    return alpha, float(top.sum() + np.log(scale).sum())


def backward(log_b: np.ndarray, a: np.ndarray) -> np.ndarray:
    b = np.exp(log_b - log_b.max(1, keepdims=True))
    beta = np.ones_like(b)
    for t in range(len(b) - 2, -1, -1):
        own = a @ (b[t + 1] * beta[t + 1])
        s = own.sum()
        beta[t] = own / s if s > 0 else 1 / len(own)
    return beta


def smoothed(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    g = alpha * beta
    s = g.sum(1, keepdims=True)
    return np.where(s > 0, g / np.where(s > 0, s, 1), 1 / g.shape[1])


def transitions(log_b: np.ndarray, alpha: np.ndarray, beta: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Expected number of moves from each state to each, each row's normalised before they are summed."""
    b = np.exp(log_b - log_b.max(1, keepdims=True))
    xi = alpha[:-1, :, None] * a * (b[1:] * beta[1:])[:, None, :]
    s = xi.sum((1, 2), keepdims=True)
    return (xi / np.where(s > 0, s, 1)).sum(0)


def viterbi(m: Model, x: np.ndarray) -> np.ndarray:
    """Likeliest path; of equal ones the lower state."""
    log_b, log_a = log_emissions(m, x), np.log(np.maximum(m.a, 1e-300))
    score = np.log(np.maximum(m.pi, 1e-300)) + log_b[0]
    back = np.zeros(log_b.shape, int)
    for t in range(1, len(x)):
        options = score[:, None] + log_a
        back[t] = options.argmax(0)
        score = options.max(0) + log_b[t]
    path = np.empty(len(x), int)
    path[-1] = score.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def predictions(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered beliefs, and the probabilities of the next row's states."""
    alpha, _ = forward(log_emissions(m, x), m.pi, m.a)
    return alpha, alpha @ m.a


def belief_step(m: Model, x: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One more row: the state to keep, the belief now, and that of the next row. The state is the last belief ahead."""
    log_b = log_emissions(m, x[None])[0]
    own = np.exp(log_b - log_b.max()) * (m.pi if state is None else state)
    s = own.sum()
    now = own / s if 0 < s < np.inf else np.full(m.k, 1 / m.k)
    return now @ m.a, now, now @ m.a


def stationary(a: np.ndarray) -> np.ndarray:
    p = np.full(len(a), 1 / len(a))
    for _ in range(500):
        new = p @ a
        if np.abs(new - p).max() < 1e-14:
            break
        p = new
    return new


def expected_durations(m: Model) -> np.ndarray:
    if m.dur is not None:
        return m.dur @ np.arange(1, m.dur.shape[1] + 1)
    stay = np.diag(m.a)
    return np.where(stay < 1, 1 / np.maximum(1 - stay, 1e-300), np.inf)


# --- fitting ----------------------------------------------------------------------------------------------------


def seeded_centers(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Centres drawn far apart, then moved to the means of what is nearest; an empty one starts anew somewhere."""
    centers = x[[rng.integers(len(x))]]
    while len(centers) < k:
        near = ((x[:, None] - centers) ** 2).sum(2).min(1)
        p = near / near.sum() if near.sum() > 0 else None
        centers = np.vstack([centers, x[rng.choice(len(x), p=p)]])
    label = None
    for _ in range(rounds):
        new = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
        if label is not None and (new == label).all():
            break
        label = new
        centers = np.array([x[label == j].mean(0) if (label == j).any() else x[rng.integers(len(x))] for j in range(k)])
    return centers, label


def first_guess(x: np.ndarray, k: int, rng: np.random.Generator, floor: float, student: bool = False) -> Model:
    """States of the clusters, which last."""
    mu, label = seeded_centers(x, k, rng)
    count = np.bincount(label, minlength=k)
    var = np.array([np.maximum(((x[label == j] - mu[j]) ** 2).mean(0), floor) if count[j] > 1 else np.ones(x.shape[1]) for j in range(k)])
    stay = 0.85 + 0.1 * rng.random(k)
    a = np.where(np.eye(k, dtype=bool), stay[:, None], ((1 - stay) / max(k - 1, 1))[:, None])
    nu = np.full(k, 8.0) if student else None
    return Model(np.maximum(count, 1e-9) / np.maximum(count, 1e-9).sum(), a, mu, var * (6 / 8 if student else 1), nu)


def solve_nu(gamma: np.ndarray, d: np.ndarray, width: int, nu: float) -> float:
    """Degrees of freedom of one state at which the expected score is none, within a factor of two of the last ones."""

    def score(v: float) -> float:
        inner = digamma((v + width) / 2) - digamma(v / 2) - width / v - np.log1p(d / v) + (v + width) * d / (v * (v + d))
        return float((gamma * inner).sum())

    low, high = max(LEAST_NU, nu / 2), min(MOST_NU, nu * 2)
    if score(low) <= 0:
        return low
    if score(high) >= 0:
        return high
    while high - low > 1e-6 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if score(middle) > 0 else (low, middle)
    return (low + high) / 2


def emission_step(m: Model, x: np.ndarray, gamma: np.ndarray, floor: float, fixed_nu: bool = False) -> Model:
    """Means, scales and degrees of freedom from state weights; a state that nothing is in keeps its own."""
    width = x.shape[1]
    d = distances(m, x)
    u = np.ones_like(gamma) if m.nu is None else (m.nu + width) / (m.nu + d)
    weight, pull = gamma.sum(0), (gamma * u).sum(0)
    alive = weight > 1e-8
    mu = np.where(alive[:, None], (gamma * u).T @ x / np.where(alive, pull, 1)[:, None], m.mu)
    apart = (x[:, None, :] - mu) ** 2
    var = np.einsum("tk,tkd->kd", gamma * u, apart) / np.where(alive, weight, 1)[:, None]
    out = replace(m, mu=mu, var=np.where(alive[:, None], np.maximum(var, floor), m.var))
    if m.nu is not None and not fixed_nu:
        d = distances(out, x)
        out = replace(out, nu=np.array([solve_nu(gamma[:, j], d[:, j], width, m.nu[j]) if alive[j] else m.nu[j] for j in range(m.k)]))
    return out


def em_step(m: Model, x: np.ndarray, floor: float = 1e-8, prior: float = 0.1, fixed_nu: bool = False) -> tuple[Model, float]:
    """One round; the log likelihood is that of the model that goes in."""
    log_b = log_emissions(m, x)
    alpha, total = forward(log_b, m.pi, m.a)
    beta = backward(log_b, m.a)
    gamma = smoothed(alpha, beta)
    moves = transitions(log_b, alpha, beta, m.a) + prior
    out = replace(m, pi=gamma[0], a=moves / moves.sum(1, keepdims=True))
    return emission_step(out, x, gamma, floor, fixed_nu), total


def _stacked(models: list[Model], log_b: np.ndarray):
    return log_b, np.stack([m.pi for m in models]), np.stack([m.a for m in models])


def em_steps(models: list[Model], x: np.ndarray, floor: float = 1e-8, prior: float = 0.1, fixed_nu: bool = False) -> list[tuple[Model, float]]:
    """:func:`em_step` of several models on the same rows, their recursions side by side."""
    log_b = np.stack([log_emissions(m, x) for m in models])
    gamma, moves, total = scan.expectations(*_stacked(models, log_b))
    out = []
    for i, m in enumerate(models):
        if np.isfinite(total[i]):
            after = moves[i] + prior
            new = replace(m, pi=gamma[i, 0], a=after / after.sum(1, keepdims=True))
            out.append((emission_step(new, x, gamma[i], floor, fixed_nu), float(total[i])))
        else:  # a row that no state explains
            out.append(em_step(m, x, floor, prior, fixed_nu))
    return out


def rounds_of(models: list[Model], step, n: int, rounds: int, tol: float) -> list[tuple[Model, float, int]]:
    """Rounds of ``step`` on models that leave once a round adds less than ``tol`` a row: model, log likelihood and rounds of each."""
    before, found = [-np.inf] * len(models), [None] * len(models)
    active = list(range(len(models)))
    for i in range(rounds):
        done = step([models[j] for j in active])
        for j, (new, total) in zip(list(active), done):
            found[j] = (models[j], total, i + 1)
            if abs(total - before[j]) < tol * n:
                active.remove(j)
            before[j], models[j] = total, new
        if not active:
            break
    return [(m.sorted(), total, n_rounds) for m, total, n_rounds in found]


def state_variance(m: Model) -> np.ndarray:
    """Variance of each feature in each state; infinite where two degrees of freedom or fewer leave none."""
    if m.nu is None:
        return m.var
    return np.where(m.nu[:, None] > 2, m.var * (m.nu / np.maximum(m.nu - 2, 1e-12))[:, None], np.inf)


def parameter_count(m: Model) -> int:
    """Free numbers of a model: first states, moves, means, scales, degrees of freedom, and the weights of durations."""
    k, width = m.mu.shape
    moves = k * (k - 1) if m.dur is None else k * max(k - 2, 0) + m.dur.size
    return k - 1 + moves + 2 * k * width + (0 if m.nu is None else k)


def fit_starts(
    x: np.ndarray, k: int, seeds: list[int], rounds: int = 200, tol: float = 1e-6, floor: float = 1e-8, prior: float = 0.1,
    student: bool = False, fixed_nu: float | None = None, starts: list[Model] | None = None,
) -> list[tuple[Model, float, int]]:
    """Model, log likelihood and rounds of each start, all of them at once; a start that has converged leaves.

    ``starts``: the models to begin with, instead of those by ``seeds``. ``fixed_nu``: degrees of freedom that stay as they are.
    """
    if len(x) < 10 * k:
        raise ValueError(f"{k} states need {10 * k} rows, there are {len(x)}")
    models = starts or [first_guess(x, k, np.random.default_rng(s), floor, student or fixed_nu is not None) for s in seeds]
    if fixed_nu is not None:
        models = [replace(m, nu=np.full(k, float(fixed_nu))) for m in models]
    return rounds_of(list(models), lambda ms: em_steps(ms, x, floor, prior, fixed_nu is not None), len(x), rounds, tol)


def fit(x: np.ndarray, k: int = 3, seed: int = 42, start: Model | None = None, **options) -> tuple[Model, float, int]:
    """One start of :func:`fit_starts`. Needs ten rows a state."""
    return fit_starts(x, k, [seed], starts=[start] if start else None, **options)[0]


def sample(m: Model, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows and states drawn from a model."""
    z = np.empty(n, int)
    z[0] = rng.choice(m.k, p=m.pi)
    for t in range(1, n):
        z[t] = rng.choice(m.k, p=m.a[z[t - 1]])
    x = m.mu[z] + np.sqrt(m.var[z]) * rng.standard_normal((n, m.mu.shape[1]))
    if m.nu is not None:
        u = rng.chisquare(m.nu[z]) / m.nu[z]
        x = m.mu[z] + (x - m.mu[z]) / np.sqrt(u)[:, None]
    return x, z
