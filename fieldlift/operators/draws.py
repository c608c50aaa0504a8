"""Hashed random numbers in numpy for whole batches of rows: counts, permutations and counts of given means.

Every number is a function of a row's key, the draw and a seed, so results don't depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Poisson(1): chances of at most 0, 1, ... 7.
_POISSON_ONE = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixer of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniforms(keys: np.ndarray, draw: np.ndarray | int, stream: int = 0) -> np.ndarray:
    """Numbers in (0, 1) for hashed keys and draws (arrays that broadcast); ``stream`` tells the numbers of one draw apart."""
    with np.errstate(over="ignore"):
        h = mix64(keys.astype(np.int64).view(_U) + _STEP * np.asarray(draw, _U) + _U(stream) * _U(0xD1B54A32D192ED03))
    return ((h >> _U(11)).astype(float) + 0.5) / (1 << 53)


def poisson_one(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Counts (row, draw) of a Poisson bootstrap; draw 0 takes each row once."""
    out = np.searchsorted(_POISSON_ONE, uniforms(keys[:, None], draws[None, :]), side="right").astype(np.int8)
    out[:, draws == 0] = 1
    return out


def permuted(place: np.ndarray, size: np.ndarray, draw: np.ndarray, seed: int, rounds: int = 6) -> np.ndarray:
    """A permutation of ``0 .. size - 1`` for each draw and group of rows of one size, at the given places.

    A Feistel network permutes the least even power of two that holds the size, and a place outside is permuted again until
    it is inside: at most a few times on average, as the power is below four times the size.
    """
    shape = np.broadcast_shapes(np.shape(place), np.shape(size), np.shape(draw))
    place, size, draw = (np.asarray(a).astype(_U).ravel() for a in np.broadcast_arrays(place, size, draw))
    half = np.ones(size.shape, _U)
    for k in range(1, 32):
        half = np.where((_U(1) << _U(2 * k)) < size, _U(k + 1), half)
    mask = (_U(1) << half) - _U(1)
    out, left = place.copy(), np.arange(place.size)
    with np.errstate(over="ignore"):
        key = mix64(draw * _STEP + _U(seed & 0xFFFFFFFF) * _U(0xD1B54A32D192ED03) + size)
        while len(left):
            a, b = out[left] >> half[left], out[left] & mask[left]
            for r in range(rounds):
                a, b = b, a ^ (mix64(b + key[left] + _U(r) * _STEP) & mask[left])
            out[left] = (a << half[left]) | b
            left = left[out[left] >= size[left]]
    return out.astype(np.int64).reshape(shape)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 1, by Stirling's series after a shift by 8."""
    shift = np.zeros(x.shape)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    s = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + s - shift


def _from_mode(u: np.ndarray, mode: np.ndarray, at_mode: np.ndarray, up, down, top: np.ndarray) -> np.ndarray:
    """Inverse distribution function with outcomes ordered by their distance from the mode: 0, +1, -1, +2, ...

    ``up(k)`` and ``down(k)`` are the ratios of the chances of k + 1 and of k - 1 to that of k.
    """
    out = mode.copy()
    left = np.flatnonzero(u >= at_mode)
    u = u[left] - at_mode[left]
    high, low = mode[left].copy(), mode[left].copy()
    p_high, p_low = at_mode[left].copy(), at_mode[left].copy()
    while len(left):
        p_high = np.where(high < top[left], p_high * up(high, left), 0.0)
        high = high + 1
        hit = u < p_high
        out[left[hit]] = high[hit]
        u = u - p_high
        p_low = np.where(low > 0, p_low * down(low, left), 0.0)
        low = low - 1
        also = ~hit & (u < p_low)
        out[left[also]] = low[also]
        u = u - p_low
        # What rounding leaves of the last chance falls to the mode.
        keep = ~hit & ~also & ((p_high > 1e-18) | (p_low > 1e-18))
        left, u, high, low, p_high, p_low = (a[keep] for a in (left, u, high, low, p_high, p_low))
    return out


def poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson counts of the given means from uniform numbers; about as many steps as a few deviations."""
    mean = np.maximum(mean, 0.0)
    mode = np.floor(mean)
    at = np.where(mean > 0, np.exp(np.where(mean > 0, mode * np.log(np.maximum(mean, 1e-300)) - mean - _log_gamma(mode + 1), 0.0)), 1.0)
    return _from_mode(u, mode, at, lambda k, r: mean[r] / (k + 1), lambda k, r: k / np.maximum(mean[r], 1e-300), np.full(mean.shape, np.inf))


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Binomial counts of n trials with chance p from uniform numbers."""
    p = np.clip(p, 0.0, 1.0)
    sure = (p == 0) | (p == 1) | (n <= 0)
    q = np.where(sure, 0.5, p)
    m = np.where(sure, 1.0, n)
    mode = np.minimum(np.floor((m + 1) * q), m)
    at = np.exp(_log_gamma(m + 1) - _log_gamma(mode + 1) - _log_gamma(m - mode + 1) + mode * np.log(q) + (m - mode) * np.log1p(-q))
    odds = q / (1 - q)
    got = _from_mode(u, mode, at, lambda k, r: (m[r] - k) / (k + 1) * odds[r], lambda k, r: k / (m[r] - k + 1) / odds[r], m)
    return np.where(sure, np.where(p == 1, np.maximum(n, 0), 0.0), got)
