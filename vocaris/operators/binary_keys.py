"""The binary-key backend: Gaussian pools, keys of segments, and resegmentation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pool_plan(n_frames: int, window: int = 200, least: int = 1024, most_rate: int = 50, share: float = 0.1) -> tuple[int, int, int]:
    """(rate, pool size, key size) for n_frames of speech; under window frames there is no pool."""
    if n_frames < window:
        raise ValueError(f"{n_frames} speech frames are fewer than one window of {window}")
    rate = max(1, min(most_rate, (n_frames - window) // least))
    pool = (n_frames - window) // rate
    return rate, pool, int(share * pool)


#: Pool windows, and frames, of one group; scores in memory at a time.
POOL_BLOCK = 256
FRAME_BLOCK = 4096
STRIP_CELLS = 4_000_000


def pool(frames: DataFrame, window: int, rate: int, block: int = POOL_BLOCK) -> DataFrame:
    """(rec, g, mu, sd): mean and population deviation, as arrays, over sliding windows of frames (rec, i,
    x: array); window g covers the frames from g x rate on, and needs all of them. A group is a block of
    windows with the frames that they cover, so that a long recording is many groups."""
    n = frames.groupBy("rec").agg((F.max("i") + 1).alias("n"))
    first = F.greatest(F.ceil((F.col("i") - window + 1) / rate), F.lit(0))
    last = F.least(F.floor(F.col("i") / rate), F.floor((F.col("n") - window) / rate))
    blocks = F.sequence(F.floor(first / block).cast("long"), F.floor(last / block).cast("long"))
    placed = frames.join(n, "rec").where(last >= first).select("rec", "i", "x", "n", F.explode(blocks).alias("b"))
    rec = frames.schema["rec"].dataType.simpleString()

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        i, x = group.i.to_numpy(), np.array(group.x.tolist(), dtype=np.float64)
        b = int(group.b.iloc[0])
        g = np.arange(b * block, min((b + 1) * block, (int(group.n.iloc[0]) - window) // rate + 1))
        lo, hi = np.searchsorted(i, g * rate), np.searchsorted(i, g * rate + window)
        g, lo, hi = g[hi > lo], lo[hi > lo], hi[hi > lo]
        mu = np.stack([x[a:c].mean(0) for a, c in zip(lo, hi)])
        sd = np.stack([x[a:c].std(0) for a, c in zip(lo, hi)])
        return pd.DataFrame({"rec": group.rec.iloc[0], "g": g, "mu": list(mu), "sd": list(sd)})

    return placed.groupBy("rec", "b").applyInPandas(one, f"rec {rec}, g long, mu array<double>, sd array<double>")


def top_gaussians(frames: DataFrame, components: DataFrame, k: int = 5, block: int = FRAME_BLOCK) -> DataFrame:
    """(rec, i, g, r): the k likeliest of components (rec, g, mu, sd) for each frame (rec, i, x), ties by g;
    sd serves as the variance, and dimensions without one don't count. Blocks of frames meet their
    recording's components, strip by strip; nothing but the k best leaves a block."""
    keyed = frames.select("rec", F.floor(F.col("i") / block).alias("b"), "i", "x")
    blocks = keyed.select("rec", F.col("b").alias("block")).distinct()
    beside = components.join(blocks, "rec").select("rec", "block", "g", "mu", "sd")
    rec = frames.schema["rec"].dataType.simpleString()

    def one(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("g")
        mu, sd = (np.array(known[c].tolist(), dtype=np.float64) for c in ("mu", "sd"))
        if not len(own) or not len(known) or not (sd > 0).any():
            return pd.DataFrame({"rec": [], "i": [], "g": [], "r": []})
        used = (sd > 0).any(1)
        mu, sd, g = mu[used], sd[used], known.g.to_numpy()[used]
        there = sd > 0
        precision, logs = np.where(there, 1 / np.where(there, sd, 1), 0.0), np.where(there, np.log(2 * np.pi * np.where(there, sd, 1)), 0.0).sum(1)
        x, n = np.array(own.x.tolist(), dtype=np.float64), min(k, len(g))
        best = np.empty((len(x), n), dtype=np.int64)
        step = max(1, STRIP_CELLS // mu.size)
        for a in range(0, len(x), step):
            ll = -0.5 * (logs + (((x[a : a + step, None] - mu) ** 2) * precision).sum(2))
            best[a : a + step] = np.argsort(-np.round(ll, 9), axis=1, kind="stable")[:, :n]
        return pd.DataFrame({"rec": np.repeat(own.rec.to_numpy(), n), "i": np.repeat(own.i.to_numpy(), n), "g": g[best].ravel(), "r": np.tile(np.arange(1, n + 1), len(x))})

    index = frames.schema["i"].dataType.simpleString()
    return keyed.groupBy("rec", "b").cogroup(beside.groupBy("rec", "block")).applyInPandas(one, f"rec {rec}, i {index}, g long, r int")


def keys(segments: DataFrame, top: DataFrame, size: int, share: float = 0.2, bin_frames: int = 100) -> DataFrame:
    """(rec, seg, g, cv, bit): how often each component is on top inside a segment (rec, seg, bbeg,
    eend), as a share, and whether it is one of the floor(share x size) most frequent. A range join
    through bins of frames."""
    bins = segments.select("rec", "seg", "bbeg", "eend", F.explode(F.sequence(F.floor(F.col("bbeg") / bin_frames), F.floor(F.col("eend") / bin_frames))).alias("bin"))
    hit = top.withColumn("bin", F.floor(F.col("i") / bin_frames)).join(bins, ["rec", "bin"]).where("i between bbeg and eend")
    n = hit.groupBy("rec", "seg", "g").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("rec", "seg")
    rank = F.row_number().over(of.orderBy(F.desc("n"), "g"))
    return n.select("rec", "seg", "g", (F.col("n") / F.sum("n").over(of)).alias("cv"), (rank <= int(share * size)).alias("bit"))


def farthest_first(means: np.ndarray, start: int, k: int) -> list[int]:
    """Greedy choice of k components, each farthest (cosine) from those chosen."""
    u = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    chosen, near = [start], 1 - u @ u[start]
    while len(chosen) < min(k, len(means)):
        near[chosen] = -np.inf
        at = int(near.argmax())
        chosen.append(at)
        near = np.minimum(near, 1 - u @ u[at])
    return chosen


def mixture(x: np.ndarray, size: int, rnd: np.random.Generator, most: int = 100, least_gain: float = 1e-3, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances of a diagonal Gaussian mixture of min(size, frames) components, by
    EM until a frame's mean log density gains under least_gain. It starts from equal weights, means at
    frames drawn by rnd, and the variances of the frames nearest to each."""
    k = min(size, len(x))
    weights, mu = np.full(k, 1 / k), x[rnd.choice(len(x), k, replace=False)]
    near = np.stack([((x - m) ** 2).sum(1) for m in mu]).argmin(0)
    var = np.stack([x[near == c].var(0) if (near == c).any() else np.zeros(x.shape[1]) for c in range(k)]) + floor
    before = -np.inf
    for _ in range(most):
        joint = component_densities(x, weights, mu, var)
        total = np.logaddexp.reduce(joint, axis=0)
        if total.mean() - before < least_gain:
            break
        before = total.mean()
        share = np.exp(joint - total)
        n = share.sum(1) + 10 * np.finfo(float).eps
        weights, mu = n / n.sum(), share @ x / n[:, None]
        var = np.stack([r @ (x - m) ** 2 / c for r, m, c in zip(share, mu, n)]) + floor
    return weights, mu, var


def component_densities(x: np.ndarray, weights: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Log densities with weights (components x frames)."""
    return np.stack([np.log(w) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(1) for w, m, v in zip(weights, mu, var)])


def smooth_runs(scores: np.ndarray, i: np.ndarray, window: int) -> np.ndarray:
    """Moving means of scores (labels x frames) inside each run of consecutive frames i; the window
    is odd and shrinks towards the ends of a run."""
    total = np.cumsum(np.pad(scores, ((0, 0), (1, 0))), axis=1)
    cuts = np.flatnonzero(np.diff(i) != 1) + 1
    n, edges = np.arange(len(i)), np.concatenate(([0], cuts, [len(i)]))
    run = np.searchsorted(cuts, n, side="right")
    half = np.minimum(np.minimum(n - edges[run], edges[run + 1] - 1 - n), (window - 1) // 2)
    return (total[:, n + half + 1] - total[:, n - half]) / (2 * half + 1)


def relabel(x: np.ndarray, i: np.ndarray, own: np.ndarray, window: int, components: int = 16) -> np.ndarray:
    """The label of each frame by mixtures of the labels' own frames; zeros if no frame has a label."""
    names = np.unique(own[~pd.isna(own)])
    if not len(names):
        return np.zeros(len(x), dtype=int)
    rnd = np.random.default_rng(0)
    scores = np.stack([np.logaddexp.reduce(component_densities(x, *mixture(x[own == name], components, rnd)), axis=0) for name in names])
    return names[smooth_runs(scores, i, window).argmax(0)].astype(int)


def resegment(frames: DataFrame, labels: DataFrame, window: int = 101, components: int = 16) -> DataFrame:
    """(rec, i, label): frames (rec, i, mfcc) scored under a diagonal Gaussian mixture of each label's
    own frames (rec, i, label), smoothed inside runs of consecutive frames, and given to the likeliest."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        x = np.array(group.mfcc.tolist(), dtype=np.float64)
        return pd.DataFrame({"rec": group.rec, "i": group.i, "label": relabel(x, group.i.to_numpy(), group.label.to_numpy(), window, components)})

    joined = frames.join(labels.select("rec", "i", "label"), ["rec", "i"], "left")
    return joined.select("rec", "i", "mfcc", "label").groupBy("rec").applyInPandas(one, "rec long, i int, label int")


def train_pool(x: np.ndarray, window: int, rate: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the size components chosen from sliding windows over x (frames x
    dimensions): the one that fits its own window best comes first, then the farthest ones."""
    starts = np.arange(0, len(x) - window + 1, rate)
    total, squares = np.cumsum(np.pad(x, ((1, 0), (0, 0))), axis=0), np.cumsum(np.pad(x**2, ((1, 0), (0, 0))), axis=0)
    mu = (total[starts + window] - total[starts]) / window
    sd = np.sqrt(np.maximum((squares[starts + window] - squares[starts]) / window - mu**2, 1e-12))
    fit = -0.5 * (np.log(2 * np.pi * sd) + sd).sum(1)
    chosen = farthest_first(mu, int(fit.argmax()), size)
    return mu[chosen], sd[chosen]


def segment_vectors(x: np.ndarray, mu: np.ndarray, sd: np.ndarray, bounds: list[tuple[int, int]], top: int = 5) -> np.ndarray:
    """Cumulative vectors (segments x components): shares of the components on top in each segment."""
    # the square, multiplied out: two matrix products for each strip of frames
    centre = x.mean(0) if len(x) else np.zeros(mu.shape[1])
    m, precision = mu - centre, 1 / sd
    fixed = np.log(2 * np.pi * sd).sum(1) + (m**2 * precision).sum(1)
    best = np.zeros((len(x), min(top, len(mu))), dtype=np.int64)
    for a in range(0, len(x), 20_000):
        y = x[a : a + 20_000] - centre
        ll = -0.5 * (fixed[None] + y**2 @ precision.T - 2 * y @ (m * precision).T)
        best[a : a + 20_000] = np.argsort(-ll, axis=1, kind="stable")[:, :top]
    out = np.zeros((len(bounds), len(mu)))
    for k, (a, b) in enumerate(bounds):
        out[k] = np.bincount(best[a : b + 1].ravel(), minlength=len(mu))
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def segment_bounds(i: np.ndarray, segment: int, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, start with context, end with context), as places among speech frames numbered i in
    their recording: inside each run of consecutive frames a segment begins every ``segment`` frames, and
    context stays inside the run. A last frame that would be a segment of its own isn't one."""
    cuts = np.flatnonzero(np.diff(i) != 1) + 1
    first, last = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(i)])) - 1
    rows = [(s, min(s + segment - 1, b), max(a, s - context), min(b, s + segment - 1 + context)) for a, b in zip(first, last) for s in range(a, b, segment)]
    return tuple(np.array(rows, dtype=np.int64).reshape(-1, 4).T)


def diarize(frames: DataFrame, window: int = 200, least: int = 1024, segment: int = 100, context: int = 100, speakers: int | None = None, most: int = 20, smooth: int = 100, components: int = 16) -> DataFrame:
    """(rec, i, label) of speech frames (rec, i, mfcc): pool, keys of overlapping segments, spectral
    clustering of their shares, labels of the frames, and resegmentation if there are two or more.
    Recordings with less speech than two windows, or one segment, have one speaker. Segments stay inside
    runs of consecutive frames."""
    from vocaris.operators.clustering import _cosines, _first_seen, blurred_enhancement, k_means, normalised_embedding, ratio_count

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        x = np.array(group.mfcc.tolist(), dtype=np.float64)
        labels = np.ones(len(x), dtype=int)
        starts, ends, before, after = segment_bounds(group.i.to_numpy(), segment, context)
        if len(x) >= 2 * window and len(starts) > 1:
            rate, _, size = pool_plan(len(x), window, least)
            mu, sd = train_pool(x, window, rate, max(2, size))
            bounds = list(zip(before, after))
            a = blurred_enhancement((_cosines(segment_vectors(x, mu, sd, bounds)) + 1) / 2)
            values = np.sort(np.linalg.eigvals(a).real)[::-1]
            k = min(speakers or ratio_count(values, most), len(starts))
            found = _first_seen(k_means(normalised_embedding(a, k), k)) + 1
            # frames between segments are of the segment before
            labels = found[np.maximum(np.searchsorted(starts, np.arange(len(x)), side="right") - 1, 0)]
            if len(np.unique(labels)) > 1:
                labels = relabel(x, group.i.to_numpy(), labels, smooth, components)
        return pd.DataFrame({"rec": group.rec, "i": group.i, "label": labels})

    return frames.select("rec", "i", "mfcc").groupBy("rec").applyInPandas(one, "rec long, i int, label int")
