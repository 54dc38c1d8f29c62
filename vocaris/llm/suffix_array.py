"""Suffix arrays by induced sorting, and longest common prefixes through the permuted array.

The texts here are shards: byte strings (values 1 to 256) between separators (0). At the byte level
every induction step handles a whole bucket at once: the suffixes of one first value that are known
so far place their left neighbours, grouped by first value, in one vector operation. Names of
leftmost-smaller substrings are sorted by the same algorithm, one level down, in plain lists, as
their alphabet is too large for a step per bucket.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the end is smaller than any suffix, so
    the last suffix is larger (L)."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    smaller = np.zeros(n, dtype=bool)
    if len(differs):
        # equal neighbours share the type of the next pair that differs; the tail run is L
        after = np.searchsorted(differs, np.arange(n - 1))
        inside = after < len(differs)
        at = differs[np.minimum(after, len(differs) - 1)]
        smaller[:-1] = inside & (text[at] < text[at + 1])
    return smaller


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes, given the leftmost-smaller ones in order (or sorted by first value)."""
    n = len(text)
    count = np.bincount(text, minlength=size)
    end = np.cumsum(count)
    start = end - count
    order = np.full(n, -1, dtype=np.int64)
    seed_value = text[seeds]
    seed_at = np.searchsorted(seed_value, np.arange(size + 1))

    # larger suffixes, ascending: bucket by bucket, each in waves
    head = start.copy()

    def place_larger(found: np.ndarray) -> np.ndarray:
        """Place the larger left neighbours of found; return those of the value being scanned."""
        left = found[found > 0] - 1
        left = left[~smaller[left]]
        if not len(left):
            return left
        values = text[left]
        by = np.argsort(values, kind="stable")
        left, values = left[by], values[by]
        new = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        rank = np.arange(len(values)) - np.repeat(new, np.diff(np.append(new, len(values))))
        order[head[values] + rank] = left
        np.add.at(head, values[new], np.diff(np.append(new, len(values))))
        return left

    order[head[text[n - 1]]] = n - 1  # the end of the text induces the last suffix
    head[text[n - 1]] += 1
    for value in np.flatnonzero(count):
        at = start[value]
        while at < head[value]:
            stop = head[value]
            place_larger(order[at:stop].copy())
            at = stop
        place_larger(seeds[seed_at[value] : seed_at[value + 1]])

    # smaller suffixes, descending
    tail = end.copy()

    def place_smaller(found: np.ndarray) -> None:
        """found is in descending order."""
        left = found[found > 0] - 1
        left = left[smaller[left]]
        if not len(left):
            return
        values = text[left]
        by = np.argsort(values, kind="stable")
        left, values = left[by], values[by]
        new = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        size_of = np.diff(np.append(new, len(values)))
        rank = np.arange(len(values)) - np.repeat(new, size_of)
        order[tail[values] - 1 - rank] = left
        np.subtract.at(tail, values[new], size_of)

    for value in np.flatnonzero(count)[::-1]:
        at = end[value]
        while at > tail[value]:
            stop = tail[value]
            place_smaller(order[stop:at][::-1].copy())
            at = stop
        # then the larger suffixes of this bucket, which lie below the smaller ones
        place_smaller(order[start[value] : head[value]][::-1].copy())
    return order


def _sort_lists(text: list[int], size: int) -> list[int]:
    """The same algorithm on plain lists, for large alphabets; text holds 0 .. size - 1."""
    n = len(text)
    if n == 1:
        return [0]
    smaller = [False] * n
    for i in range(n - 2, -1, -1):
        smaller[i] = text[i] < text[i + 1] or (text[i] == text[i + 1] and smaller[i + 1])
    count = [0] * size
    for v in text:
        count[v] += 1
    ends, total = [0] * size, 0
    for v in range(size):
        total += count[v]
        ends[v] = total
    starts = [e - c for e, c in zip(ends, count)]
    seeds = [i for i in range(1, n) if smaller[i] and not smaller[i - 1]]

    def induce(ordered: list[int]) -> list[int]:
        order = [-1] * n
        tail = ends[:]
        for i in reversed(ordered):
            tail[text[i]] -= 1
            order[tail[text[i]]] = i
        head = starts[:]
        order[head[text[n - 1]]] = n - 1
        head[text[n - 1]] += 1
        for k in range(n):
            i = order[k] - 1
            if i >= 0 and not smaller[i]:
                v = text[i]
                order[head[v]] = i
                head[v] += 1
        tail = ends[:]
        for k in range(n - 1, -1, -1):
            i = order[k] - 1
            if i >= 0 and smaller[i]:
                v = text[i]
                tail[v] -= 1
                order[tail[v]] = i
        return order

    if not seeds:
        return induce(seeds)
    first = induce(seeds)
    is_seed = [False] * n
    for i in seeds:
        is_seed[i] = True
    next_seed = dict(zip(seeds, seeds[1:]))
    name, names, before = -1, {}, None
    for i in first:
        if not is_seed[i]:
            continue
        piece = text[i : next_seed[i] + 1] if i in next_seed else None
        if piece is None or piece != before:
            name += 1
        names[i], before = name, piece
    reduced = [names[i] for i in seeds]
    if name + 1 == len(seeds):
        ordered = [0] * len(seeds)
        for k, v in enumerate(reduced):
            ordered[v] = k
    else:
        ordered = _sort_lists(reduced, name + 1)
    return induce([seeds[k] for k in ordered])


def suffix_array(text: np.ndarray, size: int = 257) -> np.ndarray:
    """Starts of all suffixes in order; a suffix that is a prefix of another is the smaller one."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = np.ascontiguousarray(text, dtype=np.int64)
    smaller = _types(text)
    seeds = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(seeds):
        return _induce(text, smaller, seeds, size)
    first = _induce(text, smaller, seeds[np.argsort(text[seeds], kind="stable")], size)
    is_seed = np.zeros(n, dtype=bool)
    is_seed[seeds] = True
    ranked = first[is_seed[first]]
    # names: equal leftmost-smaller substrings, compared through 64-bit polynomial prefixes and length
    length = np.append(np.diff(seeds) + 1, n - seeds[-1])
    of = np.zeros(n, dtype=np.int64)
    of[seeds] = np.arange(len(seeds))
    k = of[ranked]
    same = _equal_spans(text, ranked[1:], ranked[:-1], length[k[1:]], length[k[:-1]])
    same &= (k[1:] != len(seeds) - 1) & (k[:-1] != len(seeds) - 1)
    name = np.concatenate(([0], np.cumsum(~same)))
    reduced = np.empty(len(seeds), dtype=np.int64)
    reduced[k] = name
    if name[-1] + 1 == len(seeds):
        ordered = np.empty(len(seeds), dtype=np.int64)
        ordered[reduced] = np.arange(len(seeds))
    else:
        ordered = np.array(_sort_lists(reduced.tolist(), int(name[-1]) + 1), dtype=np.int64)
    return _induce(text, smaller, seeds[ordered], size)


def _equal_spans(text: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the spans at a and b (na and nb long) are equal, value by value."""
    equal = na == nb
    live = np.flatnonzero(equal)
    step = 0
    while len(live):
        live = live[na[live] > step]
        bad = text[a[live] + step] != text[b[live] + step]
        equal[live[bad]] = False
        live = live[~bad]
        step += 1
    return equal


def permuted_lcp(text: np.ndarray, order: np.ndarray, stop: int = 0) -> np.ndarray:
    """By text position: the common prefix with the suffix before it in order. The value ``stop``
    separates texts and equals nothing.

    Only irreducible positions are compared; where the values to the left are equal too, the length
    is one less than at the left neighbour. Irreducible lengths sum to O(n log n).
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    reducible = (before > 0) & (at > 0)
    reducible[reducible] = (text[before[reducible] - 1] == text[at[reducible] - 1]) & (text[at[reducible] - 1] != stop)
    live, step = at[~reducible & (before >= 0)], 0
    found = np.zeros(n, dtype=np.int64)
    one, two = np.append(text, stop), np.append(text, stop)
    one[one == stop], two[two == stop] = -1, -2
    while len(live):
        live = live[one[np.minimum(live + step, n)] == two[np.minimum(before[live] + step, n)]]
        found[live] += 1
        step += 1
    # position + length is constant along reducible positions
    level = found + at
    source = np.maximum.accumulate(np.where(reducible, -1, at))
    return np.maximum(level[source] - at, 0)
