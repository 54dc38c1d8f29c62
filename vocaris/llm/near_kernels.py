"""MinHash samples, odd sketches and exact overlaps of word-shingle sets, block by block."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from vocaris.llm.textkernels import Block, gram_hashes, mix, split_words, unique_sorted, word_hashes

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** rows) ** bands, 5e-8."""

    words: int = 4
    percent: int = 80
    bands: int = 32
    rows: int = 4
    sketch_bits: int = 512
    reject_below: float = 0.55  # an estimate; over five deviations under the limit of 0.8
    rounds: int = 3
    seed: int = 29

    @property
    def samples(self) -> int:
        return self.bands * self.rows


SETTINGS = Settings()


def shingles(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles of a block's lower-cased words, and where each row's begin. A
    row with fewer words has one, its whole sequence; a row without words has none."""
    words = split_words(block)
    hashes = word_hashes(block, words, lower=True)
    grams = gram_hashes(hashes, n)
    count = np.diff(words.first)
    per_row = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    first = np.zeros(block.rows + 1, dtype=np.int64)
    np.cumsum(per_row, out=first[1:])
    out = np.empty(first[-1], dtype=np.uint64)
    last = words.first[1:][words.row] if len(words.row) else np.zeros(0, np.int64)
    inside = np.arange(len(grams)) + n <= last[: len(grams)]
    long_rows = np.repeat(count >= n, per_row)
    out[long_rows] = grams[inside]
    for r in np.flatnonzero((count > 0) & (count < n)):
        a, b = words.first[r], words.first[r + 1]
        out[first[r]] = gram_hashes(hashes[a:b], int(b - a))[0] ^ _U(int(b - a))
    return out, first


def _multipliers(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * settings.samples + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(settings.seed))
    return base[: settings.samples] | _U(1), base[settings.samples :]


def minhashes(grams: np.ndarray, first: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and their samples (rows x samples)."""
    rows = np.flatnonzero(np.diff(first) > 0)
    out = np.empty((len(rows), settings.samples), dtype=np.uint64)
    if len(rows):
        start = first[:-1][rows]
        buffer = np.empty_like(grams)
        for k, (a, b) in enumerate(zip(*_multipliers(settings))):
            np.multiply(grams, a, out=buffer)
            np.add(buffer, b, out=buffer)
            out[:, k] = np.minimum.reduceat(buffer, start)
    return rows, out


def band_keys(samples: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    grouped = mix(samples).reshape(len(samples), settings.bands, settings.rows)
    key = np.broadcast_to(np.arange(1, settings.bands + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for j in range(settings.rows):
        key = mix(key * _U(0xD6E8FEB86659FD93) + grouped[:, :, j])
    return key


def odd_sketches(samples: np.ndarray, settings: Settings) -> np.ndarray:
    """Parity bitmaps: every sample flips the bit that its hash names (rows x bytes)."""
    k = np.arange(settings.samples, dtype=np.uint64) * _U(0xA0761D6478BD642F)
    bit = (mix(samples + k) % _U(settings.sketch_bits)).astype(np.int64)
    flips = np.zeros((len(samples), settings.sketch_bits), dtype=np.int32)
    np.add.at(flips, (np.arange(len(samples))[:, None], bit), 1)
    return np.packbits((flips & 1).astype(bool), axis=1)


_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.int64)


def estimates(a: np.ndarray, b: np.ndarray, settings: Settings) -> np.ndarray:
    """Similarities estimated from the set bits of XORed sketches (pairs x bytes each).

    m samples that differ flip 2m bits; of n bits, n/2 (1 - (1 - 2/n) ** 2m) are then odd.
    """
    n = settings.sketch_bits
    odd = np.minimum(_ONES[a ^ b].sum(axis=1), n / 2 - 1)
    differ = np.log(1 - 2 * odd / n) / (2 * np.log(1 - 2 / n))
    return 1 - differ / settings.samples


def wide_sketch(distinct: np.ndarray) -> bytes:
    """Odd sketch of a whole set, as if each shingle were a sample; a power of two of bits, about four
    for each shingle within bounds."""
    bits = min(16384, max(512, 1 << (4 * len(distinct) - 1).bit_length()))
    flips = np.bincount((mix(distinct) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(bool)).tobytes()


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Wide sketches (rows x bytes) as they would be with fewer bits."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return np.ascontiguousarray(sketches)


def most_odd(bits: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many odd bits the XOR of two linked sets' sketches has at most, by the sum of their sizes:
    linked sets differ in sizes * (100 - percent) / (100 + percent) shingles at most. Mean and 5.5
    deviations of that many random flips."""
    d = sizes * ((100 - percent) / (100 + percent))
    one, two = (1 - 2 / bits) ** d, (1 - 4 / bits) ** d
    variance = bits / 4 * (1 + (bits - 1) * two - bits * one * one)
    return bits / 2 * (1 - one) + 5.5 * np.sqrt(np.maximum(variance, 0)) + 1


def possible(query: bytes, n: int, sketches: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of sets (wide sketches of one width, sizes) that may be linked with a set of n shingles,
    and how many bits are odd."""
    fits = np.flatnonzero(100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
    if not len(fits):
        return fits, fits
    own = np.frombuffer(query, dtype=np.uint8)[None, :]
    width = min(own.shape[1], sketches.shape[1])
    a, b = folded(own, width).view(np.uint64), folded(sketches[fits], width).view(np.uint64)
    odd = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    good = odd <= most_odd(8 * width, sizes[fits] + n, percent)
    return fits[good], odd[good]


def set_digest(distinct: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles."""
    return hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 x intersection >= percent x union, on whole sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(unique_sorted(np.concatenate((a, b))))
    return 100 * common >= percent * (len(a) + len(b) - common)
