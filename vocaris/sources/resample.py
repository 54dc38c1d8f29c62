"""Band-limited resampling by a rational factor: a windowed-sinc filter bank.

Output sample k lies at k * down / up input samples. There are ``up`` filters, one for each fraction that
occurs; each is a sinc, cut off below half of the lower of the two rates and faded by a Kaiser window. A
block of outputs is one gather of input stretches and one product with the filters in turn.
"""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np


@lru_cache(maxsize=32)
def filters(up: int, down: int, zeros: int = 48, beta: float = 12.0, rolloff: float = 0.94) -> tuple[np.ndarray, int]:
    """(up x taps filters, half of their length): each sums to 1, so that a constant stays as it is."""
    cutoff = rolloff * min(1.0, up / down)  # of half the input's rate
    half = int(np.ceil(zeros / cutoff))
    at = np.arange(-half, half + 1)[None, :] - (np.arange(up)[:, None] / up)
    bank = np.sinc(cutoff * at) * np.i0(beta * np.sqrt(np.clip(1 - (at / (half + 1)) ** 2, 0, 1)))
    return bank / bank.sum(axis=1, keepdims=True), half


def resample(x: np.ndarray, rate: int, to: int, block: int = 4096) -> np.ndarray:
    """x at another rate, as doubles; outside of x there is silence. The same rate gives x itself."""
    x = np.asarray(x, dtype=np.float64)
    if rate == to or not len(x):
        return x
    if rate <= 0 or to <= 0:
        raise ValueError(f"rates must be positive, not {rate} and {to}")
    g = gcd(rate, to)
    up, down = to // g, rate // g
    bank, half = filters(up, down)
    n = len(x) * up // down
    padded = np.concatenate((np.zeros(half), x, np.zeros(half + 1)))
    out = np.empty(n)
    taps = np.arange(2 * half + 1)
    for a in range(0, n, block):
        k = np.arange(a, min(n, a + block), dtype=np.int64)
        start, phase = k * down // up, k * down % up
        out[a : a + len(k)] = np.einsum("ij,ij->i", padded[start[:, None] + taps], bank[phase])
    return out
