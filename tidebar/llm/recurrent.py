"""Small recurrent layers in numpy, forward and backward, over batches of windows (time, batch, features)."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, in float32; steep arguments are cut where the value is 0 or 1 anyway."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values()))
        factor = min(1.0, clip / (norm + 1e-12))
        for k, g in grads.items():
            g = g * factor
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.step), self.v[k] / (1 - 0.999**self.step)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def gru(table: np.ndarray, codes: np.ndarray, there: np.ndarray | None, u: np.ndarray, keep: bool = False):
    """Gated recurrent states. ``table``: input projection (with bias) of each code; gates in the order z, r, n.

    ``there`` (time, batch) marks real steps: others leave the state as it is. ``keep`` keeps what backward needs.
    """
    steps, batch = codes.shape
    size = u.shape[0]
    h = np.zeros((batch, size), np.float32)
    states, kept = np.empty((steps, batch, size), np.float32), []
    for t in range(steps):
        x = table[codes[t]]
        a = h @ u
        zr = sigmoid(x[:, : 2 * size] + a[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        inner = a[:, 2 * size :]
        n = np.tanh(x[:, 2 * size :] + r * inner)
        new = n + z * (h - n)
        if there is not None:
            new = np.where(there[t][:, None], new, h)
        if keep:
            kept.append((h, z.copy(), r.copy(), n, inner.copy()))
        states[t] = h = new
    return states, kept


def gru_back(d_states: np.ndarray, kept: list, there: np.ndarray | None, u: np.ndarray):
    """Gradients of the projected inputs (time, batch, 3 size) and of ``u``."""
    steps, batch, size = d_states.shape
    d_x, d_u = np.empty((steps, batch, 3 * size), np.float32), np.zeros_like(u)
    d_h = np.zeros((batch, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, inner = kept[t]
        d = d_states[t] + d_h
        real = d if there is None else d * there[t][:, None]
        d_n = real * (1 - z) * (1 - n * n)
        d_z = real * (h - n) * z * (1 - z)
        d_r = d_n * inner * r * (1 - r)
        gates = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_u += h.T @ gates
        d_h = real * z + gates @ u.T + (d - real)
        d_x[t] = np.concatenate([d_z, d_r, d_n], axis=1)
    return d_x, d_u


def lstm(table: np.ndarray, codes: np.ndarray, u: np.ndarray, keep: bool = False):
    """Long short-term memory states; gates in the order i, f, o, g."""
    steps, batch = codes.shape
    size = u.shape[0]
    h, c = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    states, kept = np.empty((steps, batch, size), np.float32), []
    for t in range(steps):
        a = table[codes[t]]
        a += h @ u
        gates = sigmoid(a[:, : 3 * size].copy() if keep else a[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(a[:, 3 * size :])
        new = f * c + i * g
        squashed = np.tanh(new)
        if keep:
            kept.append((h, c, i, f, o, g, squashed))
        c = new
        states[t] = h = o * squashed
    return states, kept


def lstm_back(d_states: np.ndarray, kept: list, u: np.ndarray):
    steps, batch, size = d_states.shape
    d_x, d_u = np.empty((steps, batch, 4 * size), np.float32), np.zeros_like(u)
    d_h, d_c = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, squashed = kept[t]
        d = d_states[t] + d_h
        d_c = d_c + d * o * (1 - squashed**2)
        gates = np.concatenate(
            [d_c * g * i * (1 - i), d_c * c * f * (1 - f), d * squashed * o * (1 - o), d_c * i * (1 - g * g)], axis=1
        )
        d_u += h.T @ gates
        d_h, d_c = gates @ u.T, d_c * f
        d_x[t] = gates
    return d_x, d_u


def lstm_run(table: np.ndarray, codes: np.ndarray, u: np.ndarray, states: np.ndarray) -> None:
    """The states of :func:`lstm` alone, put into ``states`` (size, time, batch).

    A gate of all windows is one stretch of memory. The logistic is 1 / (1 + exp(-x)), and the hyperbolic tangent
    2 / (1 + exp(-2x)) - 1, so that all gates take one exponential; where it overflows, the gate is 0 or -1.
    """
    steps, batch = codes.shape
    size = u.shape[0]
    scale = -np.repeat(np.array([1, 2], np.float32), [3 * size, size])
    table, u = np.ascontiguousarray((table * scale).T), np.ascontiguousarray((u * scale).T)
    a, q = np.empty((4 * size, batch), np.float32), np.empty((4 * size, batch), np.float32)
    i, f, o, g = a.reshape(4, size, batch)
    h, c, w = (np.zeros((size, batch), np.float32) for _ in range(3))
    with np.errstate(over="ignore"):
        for t in range(steps):
            table.take(codes[t], axis=1, out=a, mode="clip")
            a += np.matmul(u, h, out=q)
            np.exp(a, out=a)
            a += 1
            np.reciprocal(a, out=a)
            g *= 2
            g -= 1
            c *= f
            c += np.multiply(i, g, out=w)
            np.multiply(c, -2, out=w)
            np.exp(w, out=w)
            w += 1
            np.divide(2, w, out=w)
            w -= 1
            states[:, t] = np.multiply(w, o, out=h)


def gru_run(table: np.ndarray, codes: np.ndarray, there: np.ndarray | None, u: np.ndarray) -> np.ndarray:
    """The states of :func:`gru` alone."""
    steps, batch = codes.shape
    size = u.shape[0]
    half = np.repeat(np.array([0.5, 1], np.float32), [2 * size, size])
    table, u = table * half, u * half
    states = np.empty((steps, batch, size), np.float32)
    x, a = np.empty((batch, 3 * size), np.float32), np.empty((batch, 3 * size), np.float32)
    zr = np.empty((batch, 2 * size), np.float32)
    n, h = np.empty((batch, size), np.float32), np.zeros((batch, size), np.float32)
    for t in range(steps):
        np.take(table, codes[t], axis=0, out=x, mode="clip")
        np.matmul(h, u, out=a)
        np.add(x[:, : 2 * size], a[:, : 2 * size], out=zr)
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.multiply(zr[:, size:], a[:, 2 * size :], out=n)
        n += x[:, 2 * size :]
        np.tanh(n, out=n)
        new = np.subtract(h, n, out=states[t])
        new *= zr[:, :size]
        new += n
        if there is not None:
            np.copyto(new, h, where=~there[t][:, None])
        h = new
    return states
