"""SetSketch registers of shingle sets, and joint likelihood estimates from two sketches.

A register holds 1 - floor(log_b x) for the least exponential value x that any element of the set
draws for it, cut to [0, q + 1]; the register of a union is the greater of two. With b near 1
registers of two sets agree about as often as their Jaccard similarity. The least exponential value comes from the least uniform one, since
one is an increasing function of the other.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
_rng = np.random.default_rng(77)
_FACTORS = _rng.integers(1, 1 << 62, 512, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def registers(h: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Of sets of hashes laid end to end (set i: first[i] to first[i + 1], none empty), m registers each, as uint16."""
    n = len(first) - 1
    out = np.zeros((n, m), np.uint16)
    work = np.empty_like(h)
    for j in range(m):
        np.multiply(h, _FACTORS[j], out=work)
        work ^= work >> _U(32)
        u = (np.minimum.reduceat(work, first[:-1]).astype(np.float64) + 0.5) / 2.0**64
        x = -np.log1p(-u) / RATE
        out[:, j] = np.clip(1 - np.floor(np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def joint_jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows of a and b) of sets of known size.

    The numbers of registers that are greater in one, in the other, or equal have probabilities
    p(u - v J), p(v - u J) and the rest, for relative sizes u + v = 1 and p(x) = -log_b(1 - x (b - 1) / b).
    """
    m = a.shape[1]
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = m - more - less
    u = size_a / np.maximum(size_a + size_b, 1)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def loss(j):
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(np.maximum(x, 1e-12)) + less * np.log(np.maximum(y, 1e-12)) + same * np.log(np.maximum(1 - x - y, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12)
    for _ in range(40):  # the likelihood has one peak
        third = (high - low) / 3
        left = loss(low + third) < loss(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each group of `rows` registers; different groups never share a key by their values alone."""
    from .textkit import mix

    n, m = regs.shape
    k = m // rows
    out = np.zeros((n, k), _U)
    for r in range(rows):
        out = mix(out * _U(0x9E3779B97F4A7C15) + regs[:, r : k * rows : rows].astype(_U) + _U(1))
    return mix(out + np.arange(1, k + 1, dtype=_U) * _U(0xD1B54A32D192ED03))
