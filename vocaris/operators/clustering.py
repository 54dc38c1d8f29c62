"""Clustering of a recording's windows. Linear algebra is numpy, one recording per group; graphs,
counts and labels around it are DataFrames. Recordings of many windows are clustered on sparse graphs
and from vectors alone, so that a task's memory doesn't grow with the square of its recording.

Labels are numbered by first window; partitions, not label values, are what matters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ClusterConfig:
    # fixed values
    max_speakers: int = 25
    max_share: float = 0.25  # of the windows, as neighbours
    sparse_volume: int = 30  # how many neighbour counts are tried
    largest: int = 512  # matrices are thinned to about this size to choose p
    seed: int = 0
    restarts: int = 10


CLUSTER = ClusterConfig()


def _cosines(x: np.ndarray) -> np.ndarray:
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return u @ u.T


def _first_seen(labels: np.ndarray) -> np.ndarray:
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    rank = np.empty(len(first), dtype=int)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inverse]


def k_means(x: np.ndarray, k: int, seed: int = 0, restarts: int = 10, rounds: int = 100) -> np.ndarray:
    """Lloyd's algorithm from k-means++ starts; the best of several."""
    rnd, best, best_cost = np.random.default_rng(seed), np.zeros(len(x), int), np.inf
    k = min(k, len(x))
    for _ in range(restarts):
        centres = [x[rnd.integers(len(x))]]
        while len(centres) < k:
            d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(x[rnd.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rnd.integers(len(x))])
        c = np.array(centres)
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            labels = d.argmin(1)
            new = np.array([x[labels == j].mean(0) if (labels == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = d.min(1).sum()
        if cost < best_cost - 1e-12:
            best, best_cost = labels, cost
    return best


class Graph:
    """A p-graph as half-edges in one sorted list: an edge weighs half for each end that keeps it. Windows'
    own edges don't count, as in the Laplacian."""

    def __init__(self, neighbours: np.ndarray):
        """neighbours: for each window the p windows that it keeps."""
        n, p = neighbours.shape
        self.n = n
        source = np.repeat(np.arange(n, dtype=np.int32), p)
        target = neighbours.astype(np.int32).ravel()
        inner = source != target
        source, target = source[inner], target[inner]
        by = np.argsort(np.concatenate((source, target)), kind="stable")
        self.targets = np.concatenate((target, source))[by]
        self.degree = (np.bincount(source, minlength=n) + np.bincount(target, minlength=n)).astype(np.float64)
        self.starts = np.concatenate(([0], np.cumsum(self.degree).astype(np.int64)))

    def laplacian(self, v: np.ndarray, edges: int = 200_000) -> np.ndarray:
        """Degrees less edges, times the columns of v, some rows at a time."""
        out = 0.5 * self.degree[:, None] * v
        row = 0
        while row < self.n:
            end = max(row + 1, int(np.searchsorted(self.starts, self.starts[row] + edges, side="right")) - 1)
            end = min(end, self.n)
            lo, hi = self.starts[row], self.starts[end]
            some = np.flatnonzero(self.degree[row:end] > 0) + row
            if len(some):
                out[some] -= 0.5 * np.add.reduceat(v[self.targets[lo:hi]], self.starts[some] - lo, axis=0)
            row = end
        return out

    def connected(self) -> bool:
        seen = np.zeros(self.n, dtype=bool)
        seen[0], front = True, np.array([0])
        while len(front):
            reached = np.unique(np.concatenate([self.targets[self.starts[i] : self.starts[i + 1]] for i in front]))
            front = reached[~seen[reached]]
            seen[front] = True
        return bool(seen.all())


#: Graphs of up to so many windows are decomposed whole, which is faster there and gives the same.
WHOLE = 1024


def lowest(graph: Graph, k: int, seed: int = 0, whole: int = WHOLE, depth: int = 8, rounds: int = 200, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the k lowest eigenvalues of the graph's Laplacian, ascending, with their vectors,
    by block Lanczos with restarts.

    A block of k + 2 vectors (so that repeated eigenvalues are all found) is multiplied depth times, kept
    orthogonal to all before; the best combinations of the space start the next round, until their
    residuals are small beside the largest value. Memory is depth + 1 blocks, time is products with the
    sparse graph."""
    n = graph.n
    k = min(k, n)
    width = k + 2
    if n <= max(whole, 4 * width):
        values, vectors = np.linalg.eigh(graph.laplacian(np.eye(n)))
        return values[:k], vectors[:, :k]
    scale = highest(graph, seed)
    start = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    for _ in range(rounds):
        blocks, images = [start], [graph.laplacian(start)]
        for _ in range(depth):
            following = images[-1]
            for _ in range(2):
                for b in blocks:
                    following = following - b @ (b.T @ following)
            q, r = np.linalg.qr(following)
            good = np.abs(np.diag(r)) > 1e-10 * scale
            if not good.any():
                break
            blocks.append(q[:, good])
            images.append(graph.laplacian(blocks[-1]))
        space, image = np.concatenate(blocks, axis=1), np.concatenate(images, axis=1)
        small = space.T @ image
        values, mix = np.linalg.eigh((small + small.T) / 2)
        start = space @ mix[:, :width]
        residual = np.linalg.norm(image @ mix[:, :k] - start[:, :k] * values[:k], axis=0).max()
        if residual <= tolerance * scale:
            break
        start = np.linalg.qr(start)[0]
    return values[:k], start[:, :k]


def highest(graph: Graph, seed: int = 0, steps: int = 60) -> float:
    """The largest eigenvalue of the graph's Laplacian, by Lanczos from one vector."""
    v = np.random.default_rng(seed).normal(size=(graph.n, 1))
    space = [v / np.linalg.norm(v)]
    values: list[list[float]] = []
    for _ in range(min(steps, graph.n)):
        image = graph.laplacian(space[-1])
        values.append([float((b.T @ image)[0, 0]) for b in space])
        for _ in range(2):
            for b in space:
                image = image - b * (b.T @ image)
        size = float(np.linalg.norm(image))
        if size <= 1e-12:
            break
        space.append(image / size)
    m = len(values)
    small = np.zeros((m, m))
    for j, column in enumerate(values):
        small[: len(column), j] = column
    return max(float(np.linalg.eigvalsh(np.triu(small) + np.triu(small, 1).T)[-1]), 1e-300)


class Affinity:
    """Affinities of n windows, given row by row: the weighted mean over scales of cosines scaled to [0, 1]
    by column. A scale is (vectors, mapping, weight); mapping names the scale's vector of each window."""

    def __init__(self, scales: list[tuple[np.ndarray, np.ndarray, float]], strip: int = 1024):
        self.n = len(scales[0][1])
        total = sum(weight for _, _, weight in scales)
        self.scales = []
        for x, mapping, weight in scales:
            u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            low, high = np.full(len(u), np.inf), np.full(len(u), -np.inf)
            for a in range(0, len(u), strip):
                c = u[a : a + strip] @ u.T
                low, high = np.minimum(low, c.min(0)), np.maximum(high, c.max(0))
            self.scales.append((u, np.asarray(mapping), low, np.where(high > low, high - low, 1), high > low, weight / total))

    @classmethod
    def of(cls, x: np.ndarray) -> Affinity:
        return cls([(x, np.arange(len(x)), 1.0)])

    def rows(self, at: np.ndarray, columns: np.ndarray | slice = slice(None)) -> np.ndarray:
        out = 0.0
        for u, mapping, low, width, there, weight in self.scales:
            of = mapping[columns]
            c = u[mapping[at]] @ u[of].T
            out = out + weight * np.where(there[of], (c - low[of]) / width[of], 0.0)
        return out


def _strongest(a: np.ndarray, p: int) -> np.ndarray:
    """The p strongest of each row, the later ones of equals."""
    if p >= a.shape[1]:
        return np.broadcast_to(np.arange(a.shape[1]), a.shape)
    return np.argsort(a, axis=1, kind="stable")[:, ::-1][:, :p]


def _neighbours(affinity: Affinity, p: int, strip: int = 256) -> np.ndarray:
    """The p strongest of each window's affinities, in strips of rows."""
    return np.concatenate([_strongest(affinity.rows(np.arange(a, min(a + strip, affinity.n))), p).astype(np.int32) for a in range(0, affinity.n, strip)])


def _dense_spectrum(graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a few windows."""
    a = graph.copy()
    np.fill_diagonal(a, 0)
    return np.linalg.eigh(np.diag(np.abs(a).sum(1)) - a)


def _gaps(values: np.ndarray, most: int) -> np.ndarray:
    return np.diff(values)[: min(most, len(values))]


def least_connecting(neighbours: np.ndarray, p: int) -> int:
    """The least count of neighbours, p or more, that connects the graph: by bisection, as a graph of more
    neighbours has all edges of one of fewer. neighbours: all windows of each row, strongest first."""
    low, high = p, neighbours.shape[1]
    while low < high:
        middle = (low + high) // 2
        if Graph(neighbours[:, :middle]).connected():
            high = middle
        else:
            low = middle + 1
    return low


def choose_neighbours(affinity: np.ndarray, config: ClusterConfig = CLUSTER) -> tuple[int, int]:
    """(speakers, p): the neighbour count whose graph has the clearest eigengap for its size, on a
    thinned matrix, raised until the graph is connected."""
    n = len(affinity)
    step = max(1, n // config.largest)
    return _choose(affinity[::step, ::step], step, config)


def _choose(small: np.ndarray, step: int, config: ClusterConfig) -> tuple[int, int]:
    m = len(small)
    most = max(1, int(m * config.max_share))
    tried = np.unique(np.linspace(1, most, min(most, config.sparse_volume)).astype(int))
    ranked = _strongest(small, m) if m < 2 else np.argsort(small, axis=1, kind="stable")[:, ::-1]
    scores = []

    def gaps_of(p: int) -> tuple[np.ndarray, float]:
        graph = Graph(ranked[:, :p])
        if m <= WHOLE:
            values = np.linalg.eigvalsh(graph.laplacian(np.eye(m)))
            return _gaps(values, config.max_speakers), float(values[-1])
        return _gaps(lowest(graph, config.max_speakers + 1, config.seed)[0], config.max_speakers), highest(graph, config.seed)

    for p in tried:
        gaps, largest = gaps_of(int(p))
        scores.append((p / m) / (gaps.max() / (largest + 1e-10) + 1e-10) if len(gaps) else np.inf)
    p = least_connecting(ranked, int(tried[int(np.argmin(scores))]))
    gaps, _ = gaps_of(p)
    return (int(gaps.argmax()) + 1 if len(gaps) else 1), max(1, p * step)


def _minmax(c: np.ndarray) -> np.ndarray:
    low, high = c.min(0), c.max(0)
    return np.where(high > low, (c - low) / np.where(high > low, high - low, 1), 0.0)


def auto_spectral(x: np.ndarray, speakers: int | None = None, config: ClusterConfig = CLUSTER) -> np.ndarray:
    """Spectral clustering on the graph that the data choose; a given number of speakers is kept. Neither
    the affinity nor the graph is ever a whole matrix."""
    return _auto(Affinity.of(x), speakers, config) if len(x) > 1 else np.zeros(len(x), int)


def _auto(affinity: Affinity, speakers: int | None, config: ClusterConfig) -> np.ndarray:
    step = max(1, affinity.n // config.largest)
    some = np.arange(0, affinity.n, step)
    found, p = _choose(affinity.rows(some, some), step, config)
    k = speakers or found
    _, vectors = lowest(Graph(_neighbours(affinity, min(p, affinity.n))), k, config.seed)
    return _first_seen(k_means(vectors[:, ::-1], k, config.seed, config.restarts))


def _enhanced(a: np.ndarray) -> np.ndarray:
    a = a.copy()
    np.fill_diagonal(a, 0)
    np.fill_diagonal(a, np.maximum(a.max(1), 0))
    a = np.where(a < np.quantile(a, 0.95, axis=1, keepdims=True), a * 0.01, a)
    a = np.maximum(a, a.T)
    a = a @ a.T
    return a / a.max(1)[None, :]


def normalised_embedding(a: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k lowest eigenvectors of the normalised Laplacian of a symmetric affinity, divided by
    the roots of the degrees; each vector's largest entry is positive."""
    w = (a + a.T) / 2
    np.fill_diagonal(w, 0)
    degree = w.sum(1)
    root = np.where(degree > 0, np.sqrt(np.maximum(degree, 0)), 1.0)
    lap = -w / np.outer(root, root)
    np.fill_diagonal(lap, (degree > 0).astype(float))
    vectors = np.linalg.eigh(lap)[1][:, :k] / root[:, None]
    top = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1.0, 1.0)


def ratio_count(values: np.ndarray, most: int | None = None, stop: float = 1e-2) -> int:
    """Descending eigenvalues: the largest ratio of neighbours before the first value under stop."""
    best, at = 0.0, 1
    for i in range(1, min(len(values), (most or len(values)) + 1)):
        if values[i - 1] < stop:
            break
        ratio = values[i - 1] / values[i] if values[i] > 0 else np.inf
        if ratio > best:
            best, at = ratio, i
    return at


def spectral(x: np.ndarray, speakers: int | None = None, config: ClusterConfig = CLUSTER) -> np.ndarray:
    """Spectral clustering on the enhanced affinity, with the eigenvalue ratio's speaker count."""
    if len(x) < 2:
        return np.zeros(len(x), int)
    a = _enhanced((_cosines(x) + 1) / 2)
    values, vectors = np.linalg.eig(a)
    order = np.argsort(-values.real)
    k = speakers or ratio_count(values.real[order], config.max_speakers)
    return _first_seen(k_means(vectors.real[:, order[:k]], k, config.seed, config.restarts))


def dendrogram(x: np.ndarray) -> np.ndarray:
    """Merges (a, b, height) of average linkage on cosine distance, lowest first; a and b are windows of the
    two clusters. By nearest-neighbour chains: a chain of ever nearer clusters ends in two that are each
    other's nearest, which average linkage may merge at once.

    The mean distance of two clusters of unit vectors is 1 less the product of their means, so that the
    update of distances after a merge is one weighted mean of vectors: n² vector products in all, and
    memory for the vectors only."""
    n = len(x)
    mean = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float64)
    size, alive = np.ones(n), np.ones(n, dtype=bool)
    merges, chain, first = [], [], 0
    while len(merges) < n - 1:
        if not chain:
            while not alive[first]:
                first += 1
            chain.append(first)
        at = chain[-1]
        far = 1 - mean @ mean[at]
        far[~alive] = np.inf
        far[at] = np.inf
        nearest = int(far.argmin())
        before = chain[-2] if len(chain) > 1 else -1
        if before >= 0 and far[before] <= far[nearest] + 1e-12:
            a, b = min(at, before), max(at, before)
            merges.append((a, b, far[before]))
            mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
            del chain[-2:]
        else:
            chain.append(nearest)
    return np.array(sorted(merges, key=lambda m: m[2]), dtype=np.float64).reshape(-1, 3)


def agglomerative(x: np.ndarray, speakers: int | None = None, threshold: float | None = 0.3) -> np.ndarray:
    """Average linkage on cosine distance, until speakers clusters are left or the nearest two are
    farther apart than threshold."""
    if len(x) < 2:
        return np.zeros(len(x), int)
    merges = dendrogram(x)
    if speakers is not None:
        merges = merges[: max(0, len(x) - speakers)]
    elif threshold is not None:
        merges = merges[merges[:, 2] <= threshold]
    parent = np.arange(len(x))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b, _ in merges:
        x_, y_ = root(int(a)), root(int(b))
        parent[max(x_, y_)] = min(x_, y_)
    return _first_seen(np.array([root(i) for i in range(len(x))]))


METHODS: dict[str, Callable[..., np.ndarray]] = {"auto_spectral": auto_spectral, "spectral": spectral, "agglomerative": agglomerative}


def cluster(windows: DataFrame, method: str = "auto_spectral", speakers: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(rec, k, label) of windows (rec, k, embedding); label counts from 1. counts (rec, speakers, most)
    gives recordings a number of speakers of their own, or the most that may be found (not for
    agglomerative, which looks for no number); nulls and recordings without a row go by ``speakers``."""
    fit, each = METHODS[method], counts is not None

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        own, most = (None if not each or pd.isna(v := group[c].iloc[0]) else int(v) for c in ("speakers", "most"))
        x = np.array(group.embedding.tolist(), dtype=np.float64)
        wanted = own or speakers
        wanted = wanted and min(wanted, len(x))
        labels = fit(x, wanted) if most is None or fit is agglomerative else fit(x, wanted, config=replace(CLUSTER, max_speakers=most))
        return pd.DataFrame({"rec": group.rec, "k": group.k, "label": labels + 1})

    rows = windows.select("rec", "k", "embedding")
    if counts is not None:
        rows = rows.join(counts.select("rec", F.col("speakers").cast("int"), F.col("most").cast("int")), "rec", "left")
    return rows.groupBy("rec").applyInPandas(one, "rec long, k int, label int")


def blur(a: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing of a matrix, mirrored at the edges."""
    r = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        pad = [(r, r) if k == axis else (0, 0) for k in (0, 1)]
        wide = np.pad(a, pad, mode="symmetric")
        a = sum(w * np.take(wide, np.arange(a.shape[axis]) + j, axis=axis) for j, w in enumerate(kernel))
    return a


def blurred_enhancement(a: np.ndarray) -> np.ndarray:
    """Blur, diagonal, threshold, norm."""
    a = blur(a)
    np.fill_diagonal(a, 0)
    np.fill_diagonal(a, np.maximum(a.max(1), 0))
    a = np.where(a < np.quantile(a, 0.95, axis=1, keepdims=True), a * 0.01, a)
    return a / a.max(1)[None, :]


def anchored_count(x: np.ndarray, trials: int = 5, speakers: int = 3, samples: int = 10, sigma: float = 50.0, config: ClusterConfig = CLUSTER) -> int:
    """Speaker count of few windows: known speakers are added at random, and the most frequent estimate
    less their number counts; at least 1."""
    found = []
    for trial in range(trials):
        rnd = np.random.default_rng(trial)
        centres = rnd.normal(size=(speakers, x.shape[1])) * sigma * np.abs(x).mean()
        anchors = np.repeat(centres, samples, axis=0) + rnd.normal(size=(speakers * samples, x.shape[1])) * np.abs(x).std()
        found.append(choose_neighbours(_minmax(_cosines(np.concatenate((anchors, x)))), config)[0])
    values, counts = np.unique(found, return_counts=True)
    return max(1, int(values[counts.argmax()]) - speakers)


def by_size(x: np.ndarray, speakers: int | None = None, config: ClusterConfig = CLUSTER, few: int = 6, counted: int = 80) -> np.ndarray:
    """Automatic spectral clustering that counts small recordings with anchors, and doesn't choose a
    graph for very small ones."""
    return multi_scale([(x, np.arange(len(x)), 1.0)], speakers, config, few, counted)


def multi_scale(scales: list[tuple[np.ndarray, np.ndarray, float]], speakers: int | None = None, config: ClusterConfig = CLUSTER, few: int = 6, counted: int = 80) -> np.ndarray:
    """by_size on affinities that are fused over scales (vectors, mapping, weight), the finest one last:
    its windows are clustered."""
    x = scales[-1][0]
    if len(x) < 2:
        return np.zeros(len(x), int)
    if speakers is None and len(x) <= counted:
        speakers = min(anchored_count(x, config=config), len(x))
    affinity = Affinity(scales)
    if len(x) <= few:
        whole = affinity.rows(np.arange(len(x)))
        values, vectors = _dense_spectrum(0.5 * (whole + whole.T))
        k = speakers or int(np.argmax(np.diff(values)[: config.max_speakers])) + 1
        return _first_seen(k_means(vectors[:, :k], k, config.seed, config.restarts))
    return _auto(affinity, speakers, config)


def nearest_middle(base: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each of base's middles the place of the nearest of other's, the first one of equals."""
    order = np.argsort(other, kind="stable")
    ahead = np.searchsorted(other[order], base)
    best = np.full(len(base), -1)
    near = np.full(len(base), np.inf)
    for side in (np.clip(ahead - 1, 0, len(other) - 1), np.clip(ahead, 0, len(other) - 1)):
        at = order[np.searchsorted(other[order], other[order][side])]
        far = np.abs(other[at] - base)
        better = (far < near) | ((far == near) & (at < best))
        best, near = np.where(better, at, best), np.where(better, far, near)
    return best


def cluster_scales(windows: DataFrame, weights: dict[int, float], speakers: int | None = None, config: ClusterConfig = CLUSTER) -> DataFrame:
    """(rec, k, label) of the finest scale's windows: windows (rec, scale, k, s, e, embedding) of several
    scales, the largest number the finest, are mapped to each other by their middles and clustered on
    the mean of the scales' affinities by weight (scales without a weight don't count)."""
    finest = max(weights)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        parts = {scale: own.sort_values("k") for scale, own in group.groupby("scale")}
        if finest not in parts:
            return pd.DataFrame({"rec": [], "k": [], "label": []})
        base = parts[finest]
        middle = lambda own: ((own.s + own.e) / 2).to_numpy()
        scales = [(np.array(parts[i].embedding.tolist(), dtype=np.float64), nearest_middle(middle(base), middle(parts[i])) if i != finest else np.arange(len(base)), weights[i]) for i in sorted(weights) if i in parts]
        return pd.DataFrame({"rec": base.rec, "k": base.k, "label": multi_scale(scales, speakers, config) + 1})

    rec = windows.schema["rec"].dataType.simpleString()
    return windows.where(windows.scale.isin(*weights)).select("rec", "scale", "k", "s", "e", "embedding").groupBy("rec").applyInPandas(one, f"rec {rec}, k int, label int")


METHODS["by_size"] = by_size
