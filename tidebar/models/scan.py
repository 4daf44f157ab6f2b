"""Scans of Markov chains by blocks: rows of a block are reduced to one K x K matrix, blocks are composed, then finished.

The first axis is a batch (starts of a fit, chains of a sampler), the second is time. A sequence of n rows takes about
3 * sqrt(n) steps on arrays instead of n. The same three steps, with the blocks in different tasks, are in :mod:`.blocked`.
"""

from __future__ import annotations

import numpy as np

_TINY = 1e-300


def cut(b: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(batch, block, place, state) of (batch, row, state), the rows of the last block that are there, and of any other."""
    s, n, k = b.shape
    size = max(1, int(np.ceil(np.sqrt(n))))
    blocks = -(-n // size)
    padded = np.ones((s, blocks * size, k))
    padded[:, :n] = b
    return padded.reshape(s, blocks, size, k), n - (blocks - 1) * size, size


def products(cells: np.ndarray, rest: int, a: np.ndarray) -> np.ndarray:
    """For each block diag(b_1) a diag(b_2) a .. diag(b_n), in some scale."""
    size, k = cells.shape[2:]
    q = np.eye(k) * cells[:, :, 0, None, :]
    for at in range(1, size):
        to = cells.shape[1] - (at >= rest)
        if not to:
            break
        step = (q[:, :to] @ a[:, None]) * cells[:, :to, at, None, :]
        if not at % 4:
            step /= np.maximum(step.max((2, 3), keepdims=True), _TINY)
        q[:, :to] = step
    return q / np.maximum(q.max((2, 3), keepdims=True), _TINY)


def openings(q: np.ndarray, pi: np.ndarray, a: np.ndarray) -> np.ndarray:
    """(batch, block, state): the belief ahead with which each block begins."""
    out, now = np.empty(q.shape[:3]), pi
    for i in range(q.shape[1]):
        out[:, i] = now
        own = (now[:, None] @ q[:, i])[:, 0]
        now = ((own / own.sum(1, keepdims=True))[:, None] @ a)[:, 0]
    return out


def closings(q: np.ndarray, a: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """(batch, block, state): what follows after each block, given the state of its last row; ``after`` follows the last block."""
    out, now = np.empty(q.shape[:3]), np.ones((len(q), q.shape[2])) if after is None else after
    for i in range(q.shape[1] - 1, -1, -1):
        out[:, i] = now
        now = (a @ (q[:, i] @ now[..., None]))[..., 0]
        now = now / now.sum(1, keepdims=True)
    return out


def filtered(cells: np.ndarray, ahead: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs of each row from the openings of the blocks, and the sum of each row before it is divided by it."""
    alpha, scale = np.empty(cells.shape), np.empty(cells.shape[:3])
    for at in range(cells.shape[2]):
        own = ahead * cells[:, :, at]
        scale[:, :, at] = total = own.sum(2)
        own /= total[..., None]
        alpha[:, :, at] = own
        ahead = own @ a
    return alpha, scale


def followed(cells: np.ndarray, rest: int, after: np.ndarray, a: np.ndarray) -> np.ndarray:
    """What follows after each row, in some scale, from the closings of the blocks."""
    beta, now, back = np.ones(cells.shape), after.copy(), np.swapaxes(a, 1, 2)
    for at in range(cells.shape[2] - 1, -1, -1):
        to = cells.shape[1] - (at >= rest)
        beta[:, :to, at] = now[:, :to]
        own = (cells[:, :to, at] * now[:, :to]) @ back
        now[:, :to] = own / own.sum(2, keepdims=True)
    return beta


def _rows(cells: np.ndarray, n: int) -> np.ndarray:
    return cells.reshape(len(cells), -1, *cells.shape[3:])[:, :n]


def forward(log_b: np.ndarray, pi: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered probabilities (batch, row, state) and log likelihoods; not finite where a row has no state that explains it."""
    top = log_b.max(2, keepdims=True)
    cells, rest, _ = cut(np.exp(log_b - top))
    n = log_b.shape[1]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        alpha, scale = filtered(cells, openings(products(cells, rest, a), pi, a), a)
        return _rows(alpha, n), top.sum((1, 2)) + np.log(_rows(scale, n)).sum(1)


def expectations(log_b: np.ndarray, pi: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State weights (batch, row, state), expected moves and log likelihoods of each sequence of the batch."""
    top = log_b.max(2, keepdims=True)
    b, n = np.exp(log_b - top), log_b.shape[1]
    cells, rest, _ = cut(b)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        q = products(cells, rest, a)
        alpha, scale = filtered(cells, openings(q, pi, a), a)
        alpha, beta = _rows(alpha, n), _rows(followed(cells, rest, closings(q, a), a), n)
        total = top.sum((1, 2)) + np.log(_rows(scale, n)).sum(1)
        return weights(alpha, beta), moves(alpha[:, :-1], (b * beta)[:, 1:], a), total


def weights(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    g = alpha * beta
    s = g.sum(2, keepdims=True)
    return np.where(s > 0, g / np.where(s > 0, s, 1), 1 / g.shape[2])


def moves(before: np.ndarray, after: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Expected moves: ``before`` is the belief of a row, ``after`` what the next row and all later ones say of its states."""
    s = ((before @ a) * after).sum(2, keepdims=True)
    return a * (np.swapaxes(before / np.where(s > 0, s, 1), 1, 2) @ after)


# --- drawing paths ------------------------------------------------------------------------------------------------


def random_maps(alpha: np.ndarray, a: np.ndarray, u: np.ndarray) -> np.ndarray:
    """(batch, row, state): the state drawn for a row, for each state that the row after it may have; ``u`` decides."""
    p = alpha[:, :, None, :] * np.swapaxes(a, 1, 2)[:, None]  # (batch, row, next, own)
    dead = p.sum(3) <= 0
    if dead.any():
        p = np.where(dead[..., None], alpha[:, :, None, :], p)
    c = np.cumsum(p, 3)
    return np.minimum((c <= u[:, :, None, None] * c[..., -1:]).sum(3), a.shape[1] - 1)


def traced(maps: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The path that ends in ``last``, from the map of each row to the one before: maps of blocks first, then rows of blocks."""
    s, n, k = maps.shape
    size = max(1, int(np.ceil(np.sqrt(n)))) if n else 1
    blocks = -(-n // size)
    padded = np.broadcast_to(np.arange(k), (s, blocks * size, k)).copy()
    padded[:, :n] = maps
    cells = padded.reshape(s, blocks, size, k)
    whole = np.broadcast_to(np.arange(k), (s, blocks, k))
    for at in range(size - 1, -1, -1):
        whole = np.take_along_axis(cells[:, :, at], whole, 2)
    ends, now = np.empty((s, blocks), int), last
    for i in range(blocks - 1, -1, -1):
        ends[:, i] = now
        now = whole[np.arange(s), i, now]
    path = np.empty((s, blocks, size), int)
    for at in range(size - 1, -1, -1):
        ends = np.take_along_axis(cells[:, :, at], ends[..., None], 2)[..., 0]
        path[:, :, at] = ends
    return np.concatenate([path.reshape(s, -1)[:, :n], last[:, None]], 1)


def sample_paths(log_b: np.ndarray, pi: np.ndarray, a: np.ndarray, u: np.ndarray) -> np.ndarray | None:
    """A path of each sequence of the batch from its posterior: filter forwards, then draw a map a row and compose the maps.

    None where a row has no state that explains it.
    """
    alpha, total = forward(log_b, pi, a)
    if not np.isfinite(total).all():
        return None
    c = np.cumsum(alpha[:, -1], 1)
    last = np.minimum((c <= u[:, -1:] * c[:, -1:]).sum(1), a.shape[1] - 1)
    return traced(random_maps(alpha[:, :-1], a, u[:, :-1]), last)


# --- cheapest ways ------------------------------------------------------------------------------------------------


def cheapest(cost: np.ndarray, price: np.ndarray) -> np.ndarray:
    """(from, to): least cost of going through all rows, from a state before them to a state at the last one.

    ``cost`` is (row, state), ``price`` (from, to) of each move. Rows are halved until one is left.
    """
    m = price[None] + cost[:, None, :]
    while len(m) > 1:
        half = len(m) // 2
        pairs = (m[0 : 2 * half : 2, :, :, None] + m[1 : 2 * half : 2, None, :, :]).min(2)
        m = np.concatenate([pairs, m[2 * half :]])
    return m[0]
