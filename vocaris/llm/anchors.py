"""Content-defined anchors: positions that every long repeated string picks alike.

A string of ``length`` bytes has ``length - gram + 1`` grams of ``gram`` bytes; the grams whose hash
is its smallest are its anchors. The choice depends on the string's own bytes alone, so all its
occurrences have anchors at the same place. A text has about two anchors for every
``length - gram`` bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from vocaris.llm.textkernels import Block, mix, rolling_prefix, span_hash

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    length: int = 200
    gram: int = 96
    step: int = 5  # distance of the blocks that stand for windows in a shard
    block_bytes: int = 1 << 18  # texts whose anchors are found together
    shard_bytes: int = 2_000_000  # text of one shard, on average
    most_contexts: int = 50_000  # of one anchor in a shard; beyond it windows are counted

    @property
    def before(self) -> int:
        """Bytes in front of an anchor that one of its strings can have."""
        return self.length - self.gram


SETTINGS = Settings()


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every width consecutive values, by doubling."""
    done, out = 1, values
    while 2 * done <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


@dataclass
class Found:
    """Anchors of a block: row, byte position in the row, bytes of context on either side, hash of the
    gram, and hash of the context with the anchor's place in it."""

    row: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    gram: np.ndarray
    context: np.ndarray


def find(block: Block, settings: Settings = SETTINGS) -> Found:
    n, length, gram = len(block.data), settings.length, settings.gram
    empty = np.zeros(0, np.int64)
    if n < length:
        return Found(empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    prefix = rolling_prefix(block.data)
    starts = np.arange(n - gram + 1)
    hashes = span_hash(prefix, starts, starts + gram)
    order = (hashes >> _U(32)).astype(np.uint32)
    width = length - gram + 1
    least = _sliding(order, width, np.minimum)
    # windows that reach over the end of a row are none
    inner = block.offsets[1:-1]
    for end in inner[(inner > 0) & (inner < n)]:
        least[max(0, end - length + 1) : end] = 0
    # opening: the largest window minimum over a position equals its own value where it is a minimum
    padded = np.concatenate((np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)))
    at = np.flatnonzero((_sliding(padded, width, np.maximum) == order) & (order > 0))
    row = np.searchsorted(block.offsets, at, side="right") - 1
    begin, end = block.offsets[row], block.offsets[row + 1]
    left, right = np.minimum(settings.before, at - begin), np.minimum(length, end - at)
    ok = (left + right >= length) & (right >= gram)
    at, row, begin, left, right = at[ok], row[ok], begin[ok], left[ok], right[ok]
    context = span_hash(prefix, at - left, at + right)
    return Found(row, at - begin, left, right, hashes[at], mix(context + left.astype(np.uint64)))
