"""Vectorised word and window hashes over slices of texts, for the operators that compare passages and shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
#: Bytes of text hashed at once.
_BLOCK = 2 << 20
_WORD_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(0x5EED).integers(0, 1 << 64, 256, np.uint64)
#: Space and U+0009 to U+000D.
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, ``size`` of each."""
    if base not in _powers or len(_powers[base][0]) < size:
        own = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(size, 1), b, np.uint64)
            p[0] = 1
            own.append(np.cumprod(p))
        _powers[base] = own[0], own[1]
    return _powers[base][0][:size], _powers[base][1][:size]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end] for each span: a polynomial in random values of its bytes."""
    power, inverse = powers(_WORD_BASE, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Words (runs of other than white space) of all texts: offsets of each text in them, and a hash of each word."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None and len(bounds) else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64)
    if not len(raw):
        return np.zeros(len(bounds), np.int64), np.zeros(0, np.uint64)
    if lower:
        raw = raw + 32 * ((raw >= 65) & (raw <= 90)).astype(np.uint8)
    inside = ~_WHITE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True  # a text begins or ends here
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # by blocks of about _BLOCK bytes, one word at least
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")))
        low, high = starts[at], ends[stop - 1]
        out[at:stop] = span_hashes(raw[low:high], starts[at:stop] - low, ends[at:stop] - low)
        at = stop
    return np.searchsorted(starts, bounds), out


def rolling(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words, by its first word; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, size):
        h *= np.uint64(base & _MASK)
        h += words[j : n + j]
    return mix(h)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` (a power of two) consecutive values."""
    step = 1
    while step < size:
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
        step *= 2
    return values
