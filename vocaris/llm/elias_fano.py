"""Elias-Fano coding of non-decreasing integers, in numpy.

The low bits of each value are packed; the high bits are unary: bit i + (value i >> low) is set for each
i. n values below u take about n * (2 + log2(u / n)) bits. Counts of set bits before each 64th word give
the place of any value's bit, so that a stretch of values is decoded without those before it.
"""

from __future__ import annotations

import numpy as np

_SAMPLE = 64  # words of high bits for each count in the directory


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays head (n, low bits, words), low, high and directory of ascending unsigned values."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    low = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
    if low:
        places = np.arange(low, dtype=np.uint64)
        packed = np.concatenate([np.packbits(((part[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for part in _eighths(v)] or [np.zeros(0, np.uint8)])
    else:
        packed = np.zeros(0, np.uint8)
    at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    words = int(at[-1]) // 64 + 1 if n else 0
    bits = np.zeros(words * 64, dtype=np.uint8)
    bits[at] = 1
    high = np.packbits(bits, bitorder="little")
    ones = np.bitwise_count(high.view("<u8")).astype(np.int64) if words else np.zeros(0, np.int64)
    directory = np.r_[0, np.cumsum(ones)][::_SAMPLE].astype("<i8")
    return {"head": np.array([n, low, words], "<i8"), "low": packed, "high": high, "directory": directory}


def _eighths(v: np.ndarray, rows: int = 1 << 16) -> list[np.ndarray]:
    """Parts of a multiple of eight values, so that each part's bits fill whole bytes."""
    return [v[a : a + rows] for a in range(0, len(v), rows)]


class EliasFano:
    """Values over arrays as encode() gives them, which may be memory-mapped."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low_bits, self.words = (int(x) for x in arrays["head"])
        self.low, self.high, self.directory = arrays["low"], arrays["high"], arrays["directory"]

    def __len__(self) -> int:
        return self.n

    def _select(self, i: int) -> int:
        """Place of the i-th set bit."""
        s = int(np.searchsorted(self.directory, i, side="right")) - 1
        first = s * _SAMPLE
        words = np.frombuffer(self.high[first * 8 : (first + _SAMPLE) * 8].tobytes(), "<u8")
        before = np.cumsum(np.bitwise_count(words).astype(np.int64))
        rest = i - int(self.directory[s])
        w = int(np.searchsorted(before, rest, side="right"))
        rest -= int(before[w - 1]) if w else 0
        bits = np.unpackbits(words[w : w + 1].view(np.uint8), bitorder="little")
        return (first + w) * 64 + int(np.flatnonzero(bits)[rest])

    def decode(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Values lo to hi - 1."""
        hi = self.n if hi is None else hi
        if hi <= lo:
            return np.zeros(0, np.uint64)
        start, end = self._select(lo), self._select(hi - 1)
        first = start // 8
        bits = np.unpackbits(np.asarray(self.high[first : end // 8 + 1]), bitorder="little")
        at = np.flatnonzero(bits[start - first * 8 : end + 1 - first * 8]) + start
        out = (at - np.arange(lo, hi)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            k = self.low_bits
            for a in range(lo, hi, 1 << 16):
                b = min(hi, a + (1 << 16))
                x = np.unpackbits(np.asarray(self.low[a * k // 8 : -(-b * k // 8)]), bitorder="little")[a * k % 8 :][: (b - a) * k].reshape(b - a, k)
                wide = np.zeros((b - a, 64), np.uint8)
                wide[:, :k] = x
                out[a - lo : b - lo] |= np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.decode(i, i + 1)[0])

    def successors(self, wanted: np.ndarray, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first values at or after each wanted one, among lo to hi - 1 (hi: none), and
        whether they are equal. The stretch is decoded once for all of them."""
        hi = self.n if hi is None else hi
        values = self.decode(lo, hi)
        at = np.searchsorted(values, wanted)
        same = np.zeros(len(wanted), bool)
        inside = at < len(values)
        same[inside] = values[at[inside]] == wanted[inside]
        return at + lo, same
