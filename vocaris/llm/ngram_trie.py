"""An n-gram trie of Elias-Fano levels with quantised smoothed probabilities, in one memory-mapped file.

N-grams are stored backwards: a root is the word that is predicted, below it the word before, and so on.
A level has, for each node in the order of its parents:

* its word. A root is its 64-bit hash. Below, a word is its number in the file's own list of contexts,
  and counts from where its parent's range begins (the last value of the range before, plus one), so that
  the whole level is one ascending sequence: to find a child, add the range's base to its number and
  take the successor.
* a pointer to the first of its children, an ascending sequence too, and so is the running count of roots;
* a code of 16 bits for the smoothed probability, uniform in its logarithm over the level's range.

Smoothing merges counts: with n_k the count of the n-gram of a node at depth k,
    S_1 = mass * p(word), S_2 = n_2 + S_1, S_k = n_k + share * S_(k-1),
    D_1 = n_1 + mass,                      D_k = n_k + share * D_(k-1),
and p(word | context) = S_m / D_(m-1), where D is that of the context's own node. An n-gram that isn't
there counts 0. For each context these are probabilities: they sum to 1. S needs nothing but the nodes
above, and the context's D is a node below the context's last word, so that a text's log-probability is a
sum over its words of what lies below each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from vocaris.llm.elias_fano import EliasFano, encode

_CODES = 65535
_MAGIC = np.array([0x54524945], "<i8")


@dataclass(frozen=True)
class Smoothing:
    order: int = 2
    mass: float = 2000.0
    share: float = 0.1
    added: float = 0.1  # to every count of a single word

    def __post_init__(self):
        if self.order < 2:
            raise ValueError("an n-gram trie has two levels at least")


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of log10 values, and the least one and the step."""
    x = np.log10(values) if len(values) else np.zeros(1)
    least, step = float(x.min()), max((float(x.max()) - float(x.min())) / _CODES, 1e-300)
    return np.round((x[: len(values)] - least) / step).astype("<u2"), np.array([least, step], "<f8")


def build(roots: np.ndarray, contexts: list[np.ndarray], counts: np.ndarray, total: int, distinct: int, smoothing: Smoothing, whole: dict[int, int] | None = None) -> bytes:
    """The file of n-grams (root, contexts nearest first) in ascending order, each once, with counts.
    total and distinct are the tokens and words of all training texts; whole has the counts of roots
    of which only a part of the n-grams is here."""
    parts: dict[str, np.ndarray] = {}

    def put(name: str, arrays: dict[str, np.ndarray] | np.ndarray) -> None:
        for key, a in arrays.items() if isinstance(arrays, dict) else [("", arrays)]:
            parts[f"{name}{key}"] = np.ascontiguousarray(a)

    new = np.r_[True, roots[1:] != roots[:-1]] if len(roots) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    words = roots[first]
    n = np.add.reduceat(counts, first).astype(np.float64) if len(first) else np.zeros(0)
    if whole:
        n = np.array([whole.get(int(w), c) for w, c in zip(words, n)], dtype=np.float64)
    known = np.unique(np.concatenate(contexts)) if contexts else np.zeros(0, np.uint64)
    put("words.", encode(words))
    put("counts.", encode(np.cumsum(n)))
    put("contexts.", encode(known))
    s = smoothing.mass * (n + smoothing.added) / (total + smoothing.added * (distinct + 1))
    d = n + smoothing.mass
    codes, scale = _codes(s)
    put("codes.0", codes), put("scale.0", scale)
    parent_first = first
    for k, c in enumerate(contexts, start=1):
        new = new | np.r_[True, c[1:] != c[:-1]] if len(c) else new
        first = np.flatnonzero(new)
        pointers = np.r_[np.searchsorted(first, parent_first), len(first)]
        parent = np.repeat(np.arange(len(parent_first)), np.diff(pointers))
        ids = np.searchsorted(known, c[first])
        ends = pointers[1:] - 1
        base = np.r_[0, np.cumsum(ids[ends] + 1)] if len(ids) else np.zeros(1, np.int64)
        put(f"pointers.{k}.", encode(pointers))
        put(f"ids.{k}.", encode(base[parent] + ids))
        n = np.add.reduceat(counts, first).astype(np.float64) if len(first) else np.zeros(0)
        s = n + (1.0 if k == 1 else smoothing.share) * s[parent]
        codes, scale = _codes(s)
        put(f"codes.{k}", codes), put(f"scale.{k}", scale)
        if k < len(contexts):
            d = n + smoothing.share * d[parent]
            codes, scale = _codes(d)
            put(f"context_codes.{k}", codes), put(f"context_scale.{k}", scale)
        parent_first = first
    put("size", np.array([total, distinct], "<i8"))
    return _file(parts)


def _file(parts: dict[str, np.ndarray]) -> bytes:
    """Named arrays after a table of their types and places, each at a multiple of 8 bytes."""
    table, at = [], 0
    for name, a in parts.items():
        table.append(f"{name} {a.dtype.str} {len(a)} {at}")
        at += -(-a.nbytes // 8) * 8
    head = "\n".join(table).encode()
    head += b" " * (-len(head) % 8)
    return b"".join([_MAGIC.tobytes(), np.array([len(head)], "<i8").tobytes(), head, *[x for a in parts.values() for x in (a.tobytes(), b"\0" * (-a.nbytes % 8))]])


def _parts(raw: np.ndarray) -> dict[str, np.ndarray]:
    if raw[:8].tobytes() != _MAGIC.tobytes():
        raise ValueError("no n-gram trie")
    size = int(np.frombuffer(raw[8:16].tobytes(), "<i8")[0])
    out = {}
    for line in raw[16 : 16 + size].tobytes().decode().split("\n"):
        name, kind, n, at = line.split()
        start = 16 + size + int(at)
        out[name] = raw[start : start + int(n) * np.dtype(kind).itemsize].view(kind)
    return out


class Trie:
    """Levels over the bytes of a file, which may be memory-mapped (numpy.memmap)."""

    def __init__(self, raw: np.ndarray, smoothing: Smoothing):
        self.smoothing = smoothing
        self.parts = _parts(raw)
        self.total, self.distinct = (int(x) for x in self.parts["size"])
        self.words, self.counts, self.known = (self._ef(x) for x in ("words.", "counts.", "contexts."))
        depth = smoothing.order - 1
        self.pointers = [self._ef(f"pointers.{k}.") for k in range(1, depth + 1)]
        self.ids = [self._ef(f"ids.{k}.") for k in range(1, depth + 1)]

    def _ef(self, name: str) -> EliasFano:
        return EliasFano({key: self.parts[name + key] for key in ("head", "low", "high", "directory")})

    def _logs(self, kind: str, k: int, at: np.ndarray) -> np.ndarray:
        least, step = self.parts[f"{kind.replace('codes', 'scale')}.{k}"]
        return least + self.parts[f"{kind}.{k}"][at] * step

    def query(self, roots: np.ndarray, contexts: list[np.ndarray], whole: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of the root, log10 S, log10 D as a context) of n-grams (root, contexts nearest first)
        in ascending order of roots. D is of the root with all contexts but the farthest."""
        s_ = self.smoothing
        once = np.r_[True, roots[1:] != roots[:-1]] if len(roots) else np.zeros(0, bool)
        of = np.cumsum(once) - 1
        place, found = self.words.successors(roots[once])
        sums = np.r_[np.uint64(0), self.counts.decode()].astype(np.int64)
        n = np.zeros(len(place), np.int64)
        n[found] = sums[place[found] + 1] - sums[place[found]]
        if whole:
            n = np.array([whole.get(int(w), c) for w, c in zip(roots[once], n)], dtype=np.int64)
        one = s_.mass * (n + s_.added) / (self.total + s_.added * (self.distinct + 1))
        score = np.log10(one)[of]
        score[found[of]] = self._logs("codes", 0, place[of][found[of]])
        context = np.log10(n + s_.mass)[of]
        here, alive = place[of], found[of].copy()
        for k, c in enumerate(contexts, start=1):
            score = score + (0.0 if k == 1 else np.log10(s_.share))
            # the context's node as far as it goes: all contexts but the farthest
            if k < len(contexts):
                context = context + np.log10(s_.share)
            id_, there = self.known.successors(c)
            rows = np.flatnonzero(alive & there)
            pointers = self.pointers[k - 1].decode().astype(np.int64)
            lo, hi = pointers[here[rows]], pointers[here[rows] + 1]
            values = self.ids[k - 1].decode().astype(np.int64)
            base = np.where(lo > 0, values[np.maximum(lo - 1, 0)] + 1, 0) if len(values) else lo
            # relative to its context, the level ascends: one search for all
            at = np.searchsorted(values, base + id_[rows])
            same = (at < hi) & (values[np.minimum(at, len(values) - 1)] == base + id_[rows]) if len(values) else np.zeros(len(rows), bool)
            hit, node = rows[same], at[same]
            score[hit] = self._logs("codes", k, node)
            if k < len(contexts):
                context[hit] = self._logs("context_codes", k, node)
            alive = np.zeros(len(roots), bool)
            alive[hit] = True
            here = here.copy()
            here[hit] = node
        return n[of], score, context
