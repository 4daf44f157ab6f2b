"""Posteriors of regime models: variational for Markov and semi-Markov chains, and by Gibbs sampling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.special import digamma, lgamma
from . import chain, scan, semi
from .chain import Model


@dataclass(frozen=True)
class Priors:
    mean: float = 0.0
    kappa: float = 0.5
    shape: float = 2.0
    rate: float = 1.0
    alpha: float = 1.0
    stay: float = 8.0
    duration: float = 0.05


@dataclass
class Posterior:
    """Dirichlets of first states, moves and durations; normal-gamma of means and precisions."""

    pi: np.ndarray
    a: np.ndarray
    m: np.ndarray
    kappa: np.ndarray
    shape: np.ndarray
    rate: np.ndarray
    dur: np.ndarray | None = None

    def mean_model(self) -> Model:
        dur = None if self.dur is None else self.dur / self.dur.sum(1, keepdims=True)
        return Model(self.pi / self.pi.sum(), self.a / self.a.sum(1, keepdims=True), self.m, self.rate / np.maximum(self.shape - 1, 0.5)[:, None], None, dur)


def _expected_log(alpha: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        live = np.where(alpha > 0, alpha, 1.0)
        return np.where(alpha > 0, digamma(live) - digamma(alpha.sum(-1, keepdims=True)), -np.inf)


def _kl_dirichlet(q: np.ndarray, p: np.ndarray) -> float:
    live = p > 0
    q, p = q[live], p[live]
    return float(lgamma(q.sum()) - lgamma(p.sum()) - (lgamma(q) - lgamma(p)).sum() + ((q - p) * (digamma(q) - digamma(q.sum()))).sum())


def _emission_logs(q: Posterior, x: np.ndarray) -> np.ndarray:
    """Expected log density of each row in each state."""
    log_precision = digamma(q.shape)[:, None] - np.log(q.rate)
    level = 0.5 * (log_precision - np.log(2 * np.pi) - (1 / q.kappa)[:, None]).sum(1)
    return level - 0.5 * ((q.shape[:, None] / q.rate) * (x[:, None] - q.m) ** 2).sum(2)


def _emission_update(x: np.ndarray, gamma: np.ndarray, pr: Priors) -> tuple[np.ndarray, ...]:
    n = gamma.sum(0)
    safe = np.maximum(n, 1e-12)[:, None]
    mean = gamma.T @ x / safe
    scatter = np.einsum("tk,tkd->kd", gamma, (x[:, None] - mean) ** 2)
    kappa = pr.kappa + n
    m = (pr.kappa * pr.mean + gamma.T @ x) / kappa[:, None]
    rate = pr.rate + 0.5 * scatter + (pr.kappa * n / (2 * kappa))[:, None] * (mean - pr.mean) ** 2
    return m, kappa, pr.shape + n / 2, rate


def _kl_emissions(q: Posterior, pr: Priors) -> float:
    a, b, k = q.shape[:, None], q.rate, q.kappa[:, None]
    gamma = (a - pr.shape) * digamma(a) - lgamma(a) + lgamma(pr.shape) + pr.shape * (np.log(b) - np.log(pr.rate)) + a * (pr.rate - b) / b
    normal = 0.5 * (np.log(k / pr.kappa) + pr.kappa / k - 1 + pr.kappa * (a / b) * (q.m - pr.mean) ** 2)
    return float((gamma + normal).sum())


def fit_vb(x: np.ndarray, k: int, start: Model, pr: Priors = Priors(), rounds: int = 300, tol: float = 1e-7) -> tuple[Posterior, list[float], np.ndarray]:
    """Variational posterior, the bound after each round, and the weight of each state; semi-Markov if ``start`` is."""
    lasting = start.dur is not None
    eye = np.eye(k, dtype=bool)
    prior_a = np.where(eye, 0.0 if lasting else pr.alpha + pr.stay, pr.alpha)
    prior_pi = np.full(k, pr.alpha)
    if lasting:
        gamma, moves, durations, first, _ = semi.expectations(chain.log_emissions(start, x), *semi._weights(start))
    else:
        log_b = chain.log_emissions(start, x)
        alpha, _ = chain.forward(log_b, start.pi, start.a)
        beta = chain.backward(log_b, start.a)
        gamma, moves, durations = chain.smoothed(alpha, beta), chain.transitions(log_b, alpha, beta, start.a), None
        first = gamma[0]
    bounds: list[float] = []
    for _ in range(rounds):
        dur = None if not lasting else pr.duration + durations
        q = Posterior(prior_pi + first, np.where(prior_a > 0, prior_a + moves, 0), *_emission_update(x, gamma, pr), dur)
        log_b = _emission_logs(q, x)
        log_pi, log_a = _expected_log(q.pi), _expected_log(q.a)
        kl = _kl_dirichlet(q.pi, prior_pi) + sum(map(_kl_dirichlet, q.a, prior_a)) + _kl_emissions(q, pr)
        if lasting:
            kl += sum(_kl_dirichlet(row, np.full(len(row), pr.duration)) for row in q.dur)
            gamma, moves, durations, first, total = semi.expectations(log_b, log_pi, log_a, _expected_log(q.dur))
        else:
            alpha, total = chain.forward(log_b, np.exp(log_pi), np.exp(log_a))
            beta = chain.backward(log_b, np.exp(log_a))
            gamma, moves = chain.smoothed(alpha, beta), chain.transitions(log_b, alpha, beta, np.exp(log_a))
            first = gamma[0]
        bounds.append(total - kl)
        if len(bounds) > 1 and bounds[-1] - bounds[-2] < tol * len(x):
            break
    order = np.argsort(q.m[:, 0], kind="stable")
    q = Posterior(q.pi[order], q.a[np.ix_(order, order)], q.m[order], q.kappa[order], q.shape[order], q.rate[order], None if q.dur is None else q.dur[order])
    return q, bounds, gamma.sum(0)[order]


def posteriors(q: Posterior, x: np.ndarray) -> np.ndarray:
    """Smoothed state probabilities of new rows under a fitted posterior, by its expected logs; for display, as it looks ahead."""
    log_b, log_pi, log_a = _emission_logs(q, x), _expected_log(q.pi), _expected_log(q.a)
    if q.dur is not None:
        return semi.expectations(log_b, log_pi, log_a, _expected_log(q.dur))[0]
    a = np.exp(log_a)
    return chain.smoothed(chain.forward(log_b, np.exp(log_pi), a)[0], chain.backward(log_b, a))


def draw(q: Posterior, rng: np.random.Generator) -> Model:
    """One set of parameters from the posterior."""
    dirichlet = lambda row: np.where(row > 0, g := rng.gamma(np.maximum(row, 1e-12)) * (row > 0), 0) / max(g.sum(), 1e-300)
    precision = rng.gamma(np.broadcast_to(q.shape[:, None], q.rate.shape)) / q.rate
    var = 1 / np.maximum(precision, 1e-10)
    mu = q.m + np.sqrt(var / q.kappa[:, None]) * rng.standard_normal(q.m.shape)
    dur = None if q.dur is None else np.array([dirichlet(r) for r in q.dur])
    return Model(dirichlet(q.pi), np.array([dirichlet(r) for r in q.a]), mu, var, None, dur)


def sample_path(m: Model, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A path from its posterior: filter forwards, then draw backwards."""
    alpha, _ = chain.forward(chain.log_emissions(m, x), m.pi, m.a)
    z = np.empty(len(x), int)
    u = rng.random(len(x))
    p = alpha[-1]
    for t in range(len(x) - 1, -1, -1):
        c = np.cumsum(p)
        z[t] = min(int(np.searchsorted(c, u[t] * c[-1], side="right")), m.k - 1)
        if t:
            p = alpha[t - 1] * m.a[:, z[t]]
            if p.sum() <= 0:
                p = alpha[t - 1]
    return z


def gibbs_chains(x: np.ndarray, k: int, starts: list[Model], seeds: list[int], rounds: int = 2000, thin: int = 2, pr: Priors = Priors()) -> list[list[Model]]:
    """For each chain the draws of its second half, every ``thin``-th, states in order in each; all chains go side by side.

    Each chain has random numbers of its own, so what it draws does not depend on the others.
    """
    rngs, models, out = [np.random.default_rng(s) for s in seeds], list(starts), [[] for _ in starts]
    prior_a = np.where(np.eye(k, dtype=bool), pr.alpha + pr.stay, pr.alpha)
    n = len(x)
    for i in range(rounds):
        log_b = np.stack([chain.log_emissions(m, x) for m in models])
        u = np.stack([rng.random(n) for rng in rngs])
        paths = scan.sample_paths(log_b, np.stack([m.pi for m in models]), np.stack([m.a for m in models]), u)
        for c, rng in enumerate(rngs):
            z = paths[c] if paths is not None else sample_path(models[c], x, rng)
            hot = np.eye(k)[z]
            moves = np.bincount(z[:-1] * k + z[1:], minlength=k * k).reshape(k, k)
            models[c] = draw(Posterior(pr.alpha + hot[0], prior_a + moves, *_emission_update(x, hot, pr)), rng).sorted()
            if i >= rounds // 2 and (i - rounds // 2) % thin == 0:
                out[c].append(models[c])
    return out


def gibbs(x: np.ndarray, k: int, start: Model, seed: int = 11, **options) -> list[Model]:
    """One chain of :func:`gibbs_chains`."""
    return gibbs_chains(x, k, [start], [seed], **options)[0]
