"""Special functions of statistics for scalars and numpy arrays; there is no such library to lean on here."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
EULER = 0.5772156649015329


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_inv(p: float) -> float:
    """Quantile of the standard normal; infinite at 0 and 1."""
    if not 0 <= p <= 1:
        raise ValueError("a probability is needed")
    return -math.inf if p == 0 else math.inf if p == 1 else _NORMAL.inv_cdf(p)


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def lgamma(x) -> np.ndarray:
    return _lgamma(np.asarray(x, float))


def digamma(x) -> np.ndarray:
    """Derivative of the log gamma function for positive arguments: shifted up, then its asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def logsumexp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    """log of the sum of exponentials; minus infinity where all are."""
    top = x.max(axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(safe, axis) + np.log(np.exp(x - safe).sum(axis=axis))
