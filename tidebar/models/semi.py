"""Semi-Markov chains: states last for a duration of their own law. Segments are differences of prefix sums.

The last segment ends with the sample. Recursions are vectorised over durations, and those of the fit over a
batch of starts as well; they are in scaled numbers, all others, and those of the fit where numbers run out of range, in logs.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from ..functions.special import logsumexp
from .chain import Model, emission_step, fit_starts, log_emissions, rounds_of


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def _weights(m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _log(m.pi), _log(np.where(np.eye(m.k, dtype=bool), 0, m.a)), _log(m.dur)


def prefix(log_b: np.ndarray) -> np.ndarray:
    return np.vstack([np.zeros(log_b.shape[1]), np.cumsum(log_b, 0)])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    """As logsumexp, for loops that have silenced log(0) themselves."""
    top = np.maximum(x.max(axis), -1e300)
    return top + np.log(np.exp(x - (top if axis == 0 else top[:, None])).sum(axis))


@np.errstate(divide="ignore")
def forward(log_b: np.ndarray, log_pi, log_a, log_dur) -> tuple[np.ndarray, np.ndarray, float]:
    """alpha: a segment of the state ends at the row; entry: one starts at it; log likelihood."""
    n, k = log_b.shape
    p, most = prefix(log_b), log_dur.shape[1]
    alpha, entry = np.empty((n, k)), np.full((n + 1, k), -np.inf)
    entry[0] = log_pi
    begun, lasting = np.empty((n, k)), np.ascontiguousarray(log_dur.T)  # entry less the prefix at it
    for t in range(n):
        begun[t] = entry[t] - p[t]
        d = min(t + 1, most)
        alpha[t] = p[t + 1] + _lse(begun[t - d + 1 : t + 1][::-1] + lasting[:d], 0)
        entry[t + 1] = _lse(alpha[t][:, None] + log_a, 0)
    return alpha, entry[:n], float(logsumexp(alpha[-1], 0))


@np.errstate(divide="ignore")
def backward(log_b: np.ndarray, log_a, log_dur) -> tuple[np.ndarray, np.ndarray]:
    """beta: all after the row, given that a segment ends at it; start: all from the row on, given that one starts at it."""
    n, k = log_b.shape
    p, most = prefix(log_b), log_dur.shape[1]
    beta, start, lasting = np.zeros((n, k)), np.full((n + 1, k), -np.inf), np.ascontiguousarray(log_dur.T)
    for s in range(n - 1, -1, -1):
        d = min(n - s, most)
        ahead = p[s + 1 : s + d + 1] + beta[s : s + d]
        start[s] = _lse(ahead + lasting[:d], 0) - p[s]
        if s:
            beta[s - 1] = _lse(log_a + start[s], 1)
    return beta, start


#: Rows between two changes of scale.
_RESCALE = 4


def _scaled(log_b: np.ndarray, pi: np.ndarray, a: np.ndarray, dur: np.ndarray):
    """Expectations of a batch in plain numbers: windows of the segments that may still last, rescaled every few rows.

    ``log_b`` is (batch, row, state), the others have the batch in front too. A start of the batch whose numbers run out of range
    has a log likelihood that is not finite. With entry, start, alpha and beta (of segments that begin or end at a row) a state's
    weight is what has begun less what has ended, and a duration's is what the backward windows hold of the entries.
    """
    s, n, k = log_b.shape
    most, width = dur.shape[2], s * k
    top = log_b.max(2, keepdims=True)
    b = np.ascontiguousarray(np.exp(log_b - top).transpose(1, 0, 2).reshape(n, width))
    lasting = np.ascontiguousarray(dur.transpose(2, 0, 1).reshape(most, width))
    open_ = np.zeros((n + most, width))  # newest segment first, so that durations ascend
    entry, alpha, scale = np.empty((n, width)), np.empty((n, width)), np.ones((n, s))
    now = pi.reshape(width)
    for t in range(n):
        entry[t] = now
        window = open_[n - 1 - t : n - 1 - t + most]
        window[0] = now
        if t % _RESCALE == 0 and t:
            scale[t] = total = window.reshape(-1, s, k).sum((0, 2))
            b[t] *= np.repeat(1 / total, k)
        window *= b[t]
        ended = np.einsum("dk,dk->k", window, lasting, out=alpha[t])
        now = (ended.reshape(s, 1, k) @ a).reshape(width)
    ahead, begun, beta, held = np.zeros((n + most, width)), np.empty((n, width)), np.empty((n, width)), np.zeros((most, width))
    later, spare = np.ones(width), np.empty((most, width))
    for t in range(n - 1, -1, -1):
        beta[t] = later
        window = ahead[t : t + most]
        window[0] = later
        window *= b[t]
        started = np.einsum("dk,dk->k", window, lasting, out=begun[t])
        held += np.multiply(window, entry[t], out=spare)
        later = (a @ started.reshape(s, k, 1)).reshape(width)
    z = alpha[-1].reshape(s, k).sum(1)
    per, grid = np.repeat(1 / z, k), lambda v: v.reshape(n, s, k).transpose(1, 0, 2)
    starts, ends = grid(entry * begun * per), grid(alpha * beta * per)
    gamma = np.cumsum(starts - np.concatenate([np.zeros((s, 1, k)), ends[:, :-1]], 1), 1)
    moves = a * (np.swapaxes(grid(alpha)[:, :-1], 1, 2) @ grid(begun)[:, 1:]) / z[:, None, None]
    durations = (held * lasting * per).reshape(most, s, k).transpose(1, 2, 0)
    total = top.sum((1, 2)) + np.log(scale).sum(0) + np.log(z)
    good = np.isfinite(gamma).all((1, 2)) & np.isfinite(durations).all((1, 2))
    return np.maximum(gamma, 0), moves, durations, starts[:, 0], np.where(good, total, np.nan)


def batch_expectations(log_b: np.ndarray, log_pi, log_a, log_dur) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]]:
    """State weights by row, moves, durations and first states, all expected, and the log likelihood, of each of a batch."""
    with np.errstate(all="ignore"):
        *found, total = _scaled(log_b, np.exp(log_pi), np.exp(log_a), np.exp(log_dur))
    each = zip(*found)
    return [
        (*own, float(total[i])) if np.isfinite(total[i]) else _expectations_in_logs(log_b[i], log_pi[i], log_a[i], log_dur[i]) for i, own in enumerate(each)
    ]


def expectations(log_b: np.ndarray, log_pi, log_a, log_dur) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """:func:`batch_expectations` of one sequence."""
    return batch_expectations(log_b[None], log_pi[None], log_a[None], log_dur[None])[0]


def _expectations_in_logs(log_b: np.ndarray, log_pi, log_a, log_dur) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    n, k = log_b.shape
    alpha, entry, total = forward(log_b, log_pi, log_a, log_dur)
    beta, start = backward(log_b, log_a, log_dur)
    p, most = prefix(log_b), log_dur.shape[1]
    steps, lasting = np.zeros((n + 1, k)), np.zeros((k, most))
    for d in range(1, min(most, n) + 1):
        w = np.exp(entry[: n - d + 1] + log_dur[:, d - 1] + p[d:] - p[: n - d + 1] + beta[d - 1 :] - total)
        steps[: n - d + 1] += w
        steps[d:] -= w
        lasting[:, d - 1] = w.sum(0)
    moves = np.exp(logsumexp(alpha[:-1, :, None] + log_a + start[1:n, None, :] - total, 0)) if n > 1 else np.zeros((k, k))
    return np.cumsum(steps[:n], 0), moves, lasting, np.exp(log_pi + start[0] - total), total


def survival(dur: np.ndarray) -> np.ndarray:
    """P(duration >= d) for d = 1 .. most + 1."""
    return np.hstack([np.cumsum(dur[:, ::-1], 1)[:, ::-1], np.zeros((len(dur), 1))])


def predictions(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered beliefs over states, and of the next row: jointly over the state and how long it has lasted."""
    log_pi, log_a, log_dur = _weights(m)
    log_b = log_emissions(m, x)
    _, entry, _ = forward(log_b, log_pi, log_a, log_dur)
    n, k = log_b.shape
    p, alive = prefix(log_b), survival(m.dur)
    log_alive = _log(alive[:, :-1]).T
    with np.errstate(invalid="ignore", divide="ignore"):
        goes_on = np.where(alive[:, :-1] > 0, alive[:, 1:] / np.where(alive[:, :-1] > 0, alive[:, :-1], 1), 0).T
    leave = np.where(np.eye(k, dtype=bool), 0, m.a)
    now, ahead = np.full((n, k), 1 / k), np.full((n, k), 1 / k)
    begun = entry - p[:n]
    for t in range(n):
        d = min(t + 1, m.dur.shape[1])
        g = begun[t - d + 1 : t + 1][::-1] + log_alive[:d] + p[t + 1]
        top = g.max()
        if np.isfinite(top):
            w = np.exp(g - top)
            w /= w.sum()
            stay = (w * goes_on[:d]).sum(0)
            now[t] = w.sum(0)
            ahead[t] = stay + (now[t] - stay) @ leave
    return now, ahead


def belief_step(m: Model, x: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One more row of :func:`predictions`. The state is the belief over how long the open segment has lasted and its state.

    A table of (duration, state) is all there is to keep, however long the series.
    """
    most, alive = m.dur.shape[1], survival(m.dur)
    on = np.where(alive[:, :-1] > 0, alive[:, 1:] / np.where(alive[:, :-1] > 0, alive[:, :-1], 1), 0).T
    moves = np.where(np.eye(m.k, dtype=bool), 0, m.a)
    open_ = np.zeros((most, m.k))
    if state is None:
        open_[0] = m.pi
    else:
        last = state.reshape(most, m.k)
        open_[1:] = (last * on)[:-1]
        open_[0] = (last.sum(0) - (last * on).sum(0)) @ moves
    log_b = log_emissions(m, x[None])[0]
    w = open_ * np.exp(log_b - log_b.max())
    w = w / w.sum() if w.sum() > 0 else np.full_like(w, 1 / w.size)
    stay, now = (w * on).sum(0), w.sum(0)
    return w.ravel(), now, stay + (now - stay) @ moves


def viterbi(m: Model, x: np.ndarray) -> np.ndarray:
    """Likeliest segmentation."""
    log_pi, log_a, log_dur = _weights(m)
    p = prefix(log_emissions(m, x))
    n, k, most = len(x), m.k, m.dur.shape[1]
    entry, came = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k), int)
    best, length = np.empty((n, k)), np.zeros((n, k), int)
    entry[0] = log_pi
    begun = np.empty((n, k))
    for t in range(n):
        begun[t] = entry[t] - p[t]
        d = min(t + 1, most)
        options = begun[t - d + 1 : t + 1][::-1] + log_dur[:, :d].T
        length[t] = options.argmax(0) + 1
        best[t] = p[t + 1] + options.max(0)
        moved = best[t][:, None] + log_a
        came[t + 1], entry[t + 1] = moved.argmax(0), moved.max(0)
    path, t, z = np.empty(n, int), n - 1, int(best[-1].argmax())
    while t >= 0:
        d = int(length[t, z])
        path[t - d + 1 : t + 1] = z
        t -= d
        z = int(came[t + 1, z])
    return path


def from_chain(m: Model, most: int) -> Model:
    """The semi-Markov chain that a Markov chain is: geometric durations, cut at ``most``."""
    stay = np.clip(np.diag(m.a), 1e-6, 1 - 1e-6)[:, None]
    dur = stay ** np.arange(most) * (1 - stay)
    off = np.where(np.eye(m.k, dtype=bool), 0, m.a)
    off = np.where(off.sum(1, keepdims=True) > 0, off, 1 - np.eye(m.k))
    return replace(m, a=off / off.sum(1, keepdims=True), dur=dur / dur.sum(1, keepdims=True))


def em_steps(models: list[Model], x: np.ndarray, floor: float = 1e-8, duration_prior: float = 0.05, prior: float = 0.1) -> list[tuple[Model, float]]:
    """One round of each of several models on the same rows; the log likelihood is that of the model that goes in."""
    logs = [np.stack(v) for v in zip(*map(_weights, models))]
    out = []
    for m, (gamma, moves, lasting, first, total) in zip(models, batch_expectations(np.stack([log_emissions(m, x) for m in models]), *logs)):
        moves = np.where(np.eye(m.k, dtype=bool), 0, moves + prior)
        lasting = lasting + duration_prior
        new = replace(m, pi=first / first.sum(), a=moves / moves.sum(1, keepdims=True), dur=lasting / lasting.sum(1, keepdims=True))
        out.append((emission_step(new, x, gamma, floor), total))
    return out


def em_step(m: Model, x: np.ndarray, **options) -> tuple[Model, float]:
    return em_steps([m], x, **options)[0]


def fit_semi_starts(x: np.ndarray, k: int, most: int, seeds: list[int], rounds: int = 100, tol: float = 1e-6, student: bool = False) -> list[tuple[Model, float, int]]:
    """All starts at once, each from a Markov chain fitted to the same rows; one that has converged leaves. Needs two states."""
    models = [from_chain(m, most) for m, _, _ in fit_starts(x, k, seeds, student=student)]
    return rounds_of(models, lambda ms: em_steps(ms, x), len(x), rounds, tol)


def fit_semi(x: np.ndarray, k: int = 3, most: int = 60, seed: int = 42, **options) -> tuple[Model, float, int]:
    return fit_semi_starts(x, k, most, [seed], **options)[0]
