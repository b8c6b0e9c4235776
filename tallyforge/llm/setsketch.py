"""SetSketch registers: exponentially spaced truncated minima of element hashes.

Register j of a set holds clip(floor(1 - log_b(min_d x_j(d))), 0, 65535), where the x_j(d)
are independent exponential variables of rate ``RATE`` drawn from the element's hash. They
come from one Poisson process for each element, whose arrivals fall into random registers: an
element is dropped as soon as its next arrival is beyond the largest minimum of its set, so
a set of n elements costs n + m log m arrivals and not n * m. A union's registers are the
maxima of the registers, and equal registers are likelier the more similar two sets are.
"""

from __future__ import annotations

import numpy as np

from .words import U64, mix

REGISTERS = 256
RATE = 20.0
BASE = 1.001
BANDS, ROWS = 42, 6
_GOLD = U64(0x9E3779B97F4A7C15)
_LOG_BASE = np.log(BASE)


def sketch(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint16 registers of each set; ``first`` holds where each set's elements begin, and the
    length at last. An empty set has all registers 0."""
    n_sets, m = len(first) - 1, REGISTERS
    low = np.full(n_sets * m, np.inf)
    owner = np.repeat(np.arange(n_sets), np.diff(first))
    seed, at, k, stride = elements.copy(), np.zeros(len(elements)), 0, 1
    scale = 1.0 / (RATE * m)
    while len(seed):
        count = (k + np.arange(stride, dtype=np.int64)).astype(U64)
        h = mix(seed[:, None] + (count * _GOLD)[None, :])
        gaps = -np.log(((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        x = at[:, None] + np.cumsum(gaps, axis=1) * scale
        np.minimum.at(low, (owner[:, None] * m + (h & U64(m - 1)).astype(np.int64)).ravel(), x.ravel())
        top = low.reshape(n_sets, m).max(axis=1)
        go = x[:, -1] < top[owner]
        seed, at, owner, k = seed[go], x[go, -1], owner[go], k + stride
        stride = min(32, stride * 2) if len(seed) * stride < 1 << 19 else max(1, stride // 2)
    with np.errstate(divide="ignore"):
        value = np.floor(1.0 - np.log(low) / _LOG_BASE)
    return np.clip(np.where(np.isinf(low), 0, value), 0, 65535).astype(np.uint16).reshape(n_sets, m)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """int64 keys, a row for each set and a column for each band."""
    wide = registers[:, : BANDS * ROWS].astype(U64).reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U64)), wide.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * _GOLD + wide[:, :, r])
    return key.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / _LOG_BASE


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of pairs of sets of known sizes, from how
    many registers of ``a`` are larger, smaller and equal."""
    more = (a > b).sum(axis=-1)
    less = (a < b).sum(axis=-1)
    return likeliest(more, less, a.shape[-1] - more - less, size_a, size_b)


def likeliest(more, less, same, size_a, size_b) -> np.ndarray:
    """The log likelihood is concave in the similarity, so a golden-section search finds it."""
    u = size_a / (size_a + size_b)
    v = 1.0 - u
    lo, hi = np.zeros(np.shape(u)), np.minimum(u / v, v / u)

    def value(j):
        pm, pl = _p(np.maximum(u - v * j, 0)), _p(np.maximum(v - u * j, 0))
        tiny = 1e-12
        return more * np.log(pm + tiny) + less * np.log(pl + tiny) + same * np.log(np.maximum(1 - pm - pl, tiny))

    ratio = 0.6180339887498949
    c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fc, fd = value(c), value(d)
    for _ in range(24):
        left = fc > fd
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
        c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        fc, fd = value(c), value(d)
    return (lo + hi) / 2


def floor_for(threshold: float) -> float:
    """The estimate below which a pair isn't verified: six standard deviations under the
    threshold, so a true link is lost with a probability of about 1e-9."""
    return threshold - 6 * (threshold * (1 - threshold) / REGISTERS) ** 0.5
