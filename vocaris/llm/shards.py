"""Which windows of a shard's contexts occur again: blocks, boundary strings, and a suffix array.

A context is an anchor with the bytes around it. Every window (``length`` bytes with the anchor inside)
holds one of a few blocks: ``length - step + 1`` bytes at a multiple of ``step`` before the anchor.
Windows can only be equal if their anchors and blocks are; what is left to compare is the up to
``step - 1`` bytes on either side. Where all contexts of a block agree in these, all their windows do.
For the others the shard's text is built: for each distinct boundary its left bytes, one symbol for
the block, its right bytes. Its suffix array (induced sorting) and permuted common prefixes put
windows that are equal next to each other.
"""

from __future__ import annotations

import numpy as np

from vocaris.llm.anchors import Settings
from vocaris.llm.suffix_array import permuted_lcp, suffix_array
from vocaris.llm.textkernels import mix, rolling_prefix, span_hash

_U = np.uint64
_BLOCK = 257


def _group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts keys, and where groups of equal ones start in it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.zeros(0, np.int64)


def repeated_windows(data: np.ndarray, offsets: np.ndarray, left: np.ndarray, anchor: np.ndarray, place: np.ndarray, many: np.ndarray, settings: Settings) -> np.ndarray:
    """Boolean matrix (context, a): whether the window that starts a bytes before the anchor occurs
    again. offsets and left place contexts and their anchors in data; anchor is the gram's hash, place
    an integer that is the same only for anchors at the same byte of the same document; many marks
    contexts that occur several times."""
    n, step, length, before = len(left), settings.step, settings.length, settings.before
    out = np.zeros((n, before + 1), dtype=bool)
    prefix = rolling_prefix(data)
    begin, end = offsets[:-1], offsets[1:]
    at = begin + left
    size = length - step + 1
    entries = []
    for a in range(0, before + 1, step):
        ok = np.flatnonzero((left >= a) & (at - a + size <= end))
        if not len(ok):
            continue
        start = at[ok] - a
        key = mix(span_hash(prefix, start, start + size) ^ mix(anchor[ok] + _U(a)))
        low = np.maximum(begin[ok], np.maximum(start - (step - 1), at[ok] - before))
        high = np.minimum(end[ok], start + size + step - 1)
        shape = mix(span_hash(prefix, low, high) ^ key) ^ mix((start - low).astype(np.uint64) * _U(1000) + (high - start).astype(np.uint64))
        entries.append((ok, np.full(len(ok), a), start, low, high, key, shape))
    if not entries:
        return out
    context, offset, start, low, high, key, shape = (np.concatenate(x) for x in zip(*entries))
    where = place[context] - offset  # where the block starts

    order, first = _group(key)
    sizes = np.diff(np.append(first, len(order)))
    group = np.empty(len(key), dtype=np.int64)
    group[order] = np.repeat(np.arange(len(first)), sizes)
    least, most = np.minimum.reduceat(where[order], first), np.maximum.reduceat(where[order], first)
    multi = np.maximum.reduceat(many[context][order], first)
    live = (least != most) | multi
    shaped = shape[order]
    same = np.minimum.reduceat(shaped, first) == np.maximum.reduceat(shaped, first)

    def mark(rows: np.ndarray, t: np.ndarray) -> None:
        out[context[rows], offset[rows] + t] = True

    # one shape for the whole group: every window inside it is repeated
    rows = np.flatnonzero((live & same)[group])
    for t in range(step):
        ok = rows[(start[rows] - t >= low[rows]) & (start[rows] - t + length <= high[rows])]
        mark(ok, np.full(len(ok), t))

    rows = np.flatnonzero((live & ~same)[group])
    if not len(rows):
        return out
    # a distinct shape is one string of the shard's text
    order, first = _group(shape[rows])
    sizes = np.diff(np.append(first, len(order)))
    unit = np.empty(len(rows), dtype=np.int64)
    unit[order] = np.repeat(np.arange(len(first)), sizes)
    one = rows[order[first]]
    unit_group = group[one]
    unit_least, unit_most = np.minimum.reduceat(where[rows][order], first), np.maximum.reduceat(where[rows][order], first)
    unit_multi = np.maximum.reduceat(many[context[rows]][order], first)
    n_left, n_right = start[one] - low[one], high[one] - start[one] - size
    width = n_left + n_right + 2
    unit_at = np.concatenate(([0], np.cumsum(width)))
    text = np.zeros(unit_at[-1], dtype=np.int64)
    for j in range(step - 1):
        has = np.flatnonzero(n_left > j)
        text[unit_at[has] + j] = data[low[one[has]] + j].astype(np.int64) + 1
        has = np.flatnonzero(n_right > j)
        text[unit_at[has] + n_left[has] + 1 + j] = data[start[one[has]] + size + j].astype(np.int64) + 1
    text[unit_at[:-1] + n_left] = _BLOCK
    array = suffix_array(text, _BLOCK + 1)
    common = permuted_lcp(text, array)
    run = np.cumsum(common[array] < step)
    # windows: t left bytes, the block, and as many right bytes as make step symbols
    owner = np.repeat(np.arange(len(width)), width)[array]
    t = n_left[owner] - (array - unit_at[owner])
    valid = np.flatnonzero((t >= 0) & (t < step) & (n_right[owner] >= step - 1 - t))
    owner, t, run = owner[valid], t[valid], run[valid]
    order, first = _group(mix(run.astype(np.uint64)) ^ mix(unit_group[owner].astype(np.uint64) + _U(1 << 40)))
    sizes = np.diff(np.append(first, len(order)))
    again = (np.minimum.reduceat(unit_least[owner][order], first) != np.maximum.reduceat(unit_most[owner][order], first)) | np.maximum.reduceat(unit_multi[owner][order], first)
    hit = order[np.repeat(again, sizes)]
    flags = np.zeros((len(width), step), dtype=bool)
    flags[owner[hit], t[hit]] = True
    for k in range(step):
        ok = rows[flags[unit, k]]
        mark(ok, np.full(len(ok), k))
    return out


def spans(windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last): maximal bytes covered by each context's repeated windows, relative to
    its anchor. Windows of one context all hold the anchor, so they cover one stretch."""
    rows = np.flatnonzero(windows.any(axis=1))
    part = windows[rows]
    near = part.argmax(axis=1)
    far = windows.shape[1] - 1 - part[:, ::-1].argmax(axis=1)
    return rows, -far, length - near
