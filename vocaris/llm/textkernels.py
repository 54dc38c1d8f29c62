"""Vectorised byte kernels that the corpus operators share.

They work on the raw buffers of an Arrow string column, a block of whole documents at a time, so
that the working memory depends on the block size (or on the longest single text, if that is
longer) and never on the number of rows. A null text counts as the empty text.

White space is ``[\\x20\\x09-\\x0D]``; a word is a maximal run of other bytes, which in UTF-8 are
the same words as ``[^\\x20\\x09-\\x0D]+`` finds in the decoded text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the hash base and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(12, (n - 1).bit_length())
        _powers = np.full(size, _BASE, dtype=np.uint64)
        _inverses = np.full(size, _BASE_INVERSE, dtype=np.uint64)
        _powers[0] = _inverses[0] = 1
        _powers = np.multiply.accumulate(_powers)
        _inverses = np.multiply.accumulate(_inverses)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


@dataclass
class Block:
    """Consecutive rows of a batch: their bytes back to back and where each row starts."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def utf8_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if large else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Whole rows, about block_bytes at a time; a longer row is a block of its own."""
    data, offs = utf8_buffers(texts)
    row, n = 0, len(offs) - 1
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + block_bytes, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield Block(row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row])
        row = end


def rolling_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; see span_hash."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * pw[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes between start and end, equal for equal bytes wherever they lie."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a block: byte spans, the row of each, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # rows + 1 offsets into the words


def split_words(block: Block) -> Words:
    n = len(block.data)
    word = ~SPACE[block.data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = block.offsets[(block.offsets > 0) & (block.offsets < n)]
    begins[inner] |= word[inner]
    ends = np.zeros(n + 1, dtype=bool)
    ends[1:n] = word[:-1] & ~word[1:] if n else False
    if n:
        ends[n] = word[n - 1]
        ends[inner] |= word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    first = np.searchsorted(start, block.offsets)
    row = np.repeat(np.arange(block.rows), np.diff(first))
    return Words(start, end, row, first)


def word_hashes(block: Block, words: Words, lower: bool = False) -> np.ndarray:
    data = LOWER[block.data] if lower else block.data
    return span_hash(rolling_prefix(data), words.start, words.end)


_STEP = [_U(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive hashes, ordered; fewer than n give none."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out += hashes[j : j + m] * _STEP[j % len(_STEP)] * _U(2 * j + 1)
    return mix(out)


def unique_sorted(x: np.ndarray) -> np.ndarray:
    """Distinct values, ascending."""
    if len(x) < 2:
        return x
    x = np.sort(x)
    keep = np.empty(len(x), dtype=bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]
