"""Toxicity: a character n-gram linear classifier on naive-Bayes-scaled features.

A text's features are its distinct character n-grams (lower-cased, runs of anything but letters
made one blank), hashed. Feature f has the value r_f, its naive Bayes log-count ratio

    r_f = log((a + toxic texts with f) / (2a + toxic texts)) - log((a + other texts with f) / (2a + other texts)),

and a logistic regression with an L2 penalty is fitted on those values, both classes weighing the
same. Features whose shares of the two classes don't differ significantly (a two-proportion z
below ``Settings.least_z``) are left out: they carry no evidence, and in long texts their noise
would add up.

The intercept says where the threshold lies. The fit's own makes both classes weigh the same, which is no
cut between them. So the fit is repeated with each of ``Settings.folds`` parts of the training sample left
out, counts, ratios and selection included, and the intercept is moved so that the score is
``Settings.threshold`` at the value that parts left-out rows best: the largest F1, clean rows weighing as
many as they stand for; of equally good values the middle of the widest gap.

The fit uses a sample of the labelled ids that is bounded by ``Settings.per_class`` for each label
(a hash of the id below a threshold), one row of each; every text is scored whole.

Defined cases: a null text scores like the empty text (the model's intercept); without labelled rows
of both kinds every score is 0; rows of one id that labels give twice are toxic if any label says
so; of an id that docs give several texts, the one with the smallest hash is learnt from; repeated
rows are each scored; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocaris.llm.frames import append_columns, crc32_of_id, cut, map_arrow, without
from vocaris.llm.langid import _letters
from vocaris.llm.textkernels import mix, unique_sorted

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    per_class: int = 5000
    smoothing: float = 1.0
    least_texts: int = 3
    least_z: float = 4.0
    penalty: float = 1e-3
    steps: int = 150
    threshold: float = 0.7
    folds: int = 3  # for the intercept; 0 leaves the fit's own
    seed: int = 11


SETTINGS = Settings()


def features(text: str | None, settings: Settings) -> np.ndarray:
    """Distinct hashed n-grams of the whole text, ascending."""
    if not text:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    clean = np.zeros(len(points) + 2, dtype=np.uint64)
    clean[1:-1] = np.where(letter, points, 0)
    clean = clean[np.concatenate(([True], (clean[1:] != 0) | (clean[:-1] != 0)))]
    if clean[-1]:
        clean = np.append(clean, _U(0))
    found, shift = [], _U(64 - settings.bits)
    code, n = clean.copy(), 1
    for size in sorted(settings.sizes):
        while n < size:
            if len(code) < 2:
                break
            code = code[:-1] * _U(0x9E3779B97F4A7C15) + clean[n:]
            n += 1
        if n == size and len(code):
            found.append((mix(code + _U(size)) >> shift).astype(np.uint32))
    return unique_sorted(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    settings: Settings = SETTINGS
    intercept: float = -np.inf
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        z = self.intercept + float(self.weights[features(text, self.settings)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def log_count_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, smoothing: float) -> np.ndarray:
    return np.log((toxic + smoothing) / (n_toxic + 2 * smoothing)) - np.log((other + smoothing) / (n_other + 2 * smoothing))


def significance(toxic: Column, other: Column, n_toxic: int, n_other: int) -> Column:
    """z of the difference between the two classes' shares of texts that have the feature."""
    share = (toxic + other) / (n_toxic + n_other)
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n_toxic + 1 / n_other))
    return (toxic / n_toxic - other / n_other) / spread


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, values: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights of the values and the intercept; rows hold indices into values. Full-batch Adam on
    the mean log loss of each class, so the result doesn't depend on the order of rows."""
    share = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, int)
    x = values[col]
    theta, m, v = np.zeros(len(values) + 1), np.zeros(len(values) + 1), np.zeros(len(values) + 1)
    for step in range(1, settings.steps + 1):
        z = np.bincount(row, weights=x * theta[col], minlength=len(rows)) + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) * share
        grad = np.append(np.bincount(col, weights=x * error[row], minlength=len(values)) + settings.penalty * theta[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = SETTINGS) -> Model:
    """Fit on the rows of labels (ids with label 0 or 1) and their texts in docs."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(settings)
    limit = F.lit(0)
    for y, n in sizes.items():
        limit = F.when(F.col("y") == y, F.lit(int(min(1.0, settings.per_class / n) * (1 << 30)) + 1)).otherwise(limit)
    picked = known.where(F.pmod(F.xxhash64("i", F.lit(settings.seed)), F.lit(1 << 30)) < limit)
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # at most about 2 x per_class ids and as many rows, whatever the tables' sizes
    chosen = texts.join(F.broadcast(picked), "i").groupBy("i", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    folds = max(1, settings.folds)
    sample = cut(chosen.select("y", "t", F.pmod(F.xxhash64("i", F.lit(settings.seed + 1)), F.lit(folds)).cast("int").alias("k")))
    bits = settings.bits
    names = [f"{c}{k}" for c in "qp" for k in range(folds)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((2 * folds, 1 << bits), dtype=np.int32)
        for batch in batches:
            for y, t, k in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                tally[y * folds + k, features(t.as_py(), settings)] += 1
        seen = np.flatnonzero(tally.any(axis=0))
        for at in range(0, len(seen), 1 << 16):
            f = seen[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), *[pa.array(tally[j, f].astype(np.int64)) for j in range(2 * folds)]], names=["f", *names])

    of_part = {(r.y, r.k): r.n for r in sample.groupBy("y", "k").agg(F.count(F.lit(1)).alias("n")).collect()}
    numbers = np.array([[of_part.get((y, k), 0) for k in range(folds)] for y in (0, 1)])
    if not numbers.sum(1).all():
        return Model(settings)
    table = sample.mapInArrow(count, "f int, " + ", ".join(f"{c} long" for c in names)).groupBy("f").agg(*[F.sum(c).alias(c) for c in names])
    # the whole sample, and each part left out, where both classes are left
    cuts = [np.ones(folds, bool)]
    if settings.folds > 1:
        cuts += [np.arange(folds) != k for k in range(folds)]
    cuts = [c for c in cuts if (numbers[:, c].sum(1) > 0).all()]
    sums = lambda c, used: sum((F.col(f"{c}{k}") for k in np.flatnonzero(used)), F.lit(0))
    wanted = [(sums("p", c) + sums("q", c) >= settings.least_texts) & (F.abs(significance(sums("p", c), sums("q", c), int(numbers[1, c].sum()), int(numbers[0, c].sum()))) >= settings.least_z) for c in cuts]
    chosen_by = [w.alias(f"w{j}") for j, w in enumerate(wanted)]
    # of at most 2 ** bits features, those that are significant in one of them
    counts = table.select("f", *names, *chosen_by).where(" or ".join(f"w{j}" for j in range(len(cuts)))).toPandas().sort_values("f")
    ids = counts.f.to_numpy()
    index = np.full(1 << bits, -1, dtype=np.int32)
    index[ids] = np.arange(len(ids))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for batch in batches:
            found = [where[features(t.as_py(), settings)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f[f >= 0].tobytes() for f in found], pa.binary())], names=["y", "k", "x"])

    # the bounded sample, in an order that doesn't depend on tasks
    gathered = sorted(sample.mapInArrow(thin, "y int, k int, x binary").collect(), key=lambda r: (r.y, bytes(r.x), r.k))
    shared.destroy()
    rows = [np.frombuffer(r.x, dtype=np.int32) for r in gathered]
    y, part = np.array([r.y for r in gathered], dtype=np.float64), np.array([r.k for r in gathered])

    def fitted(j: int, cut_: np.ndarray) -> tuple[np.ndarray, float]:
        used = counts[f"w{j}"].to_numpy(dtype=bool)
        p, q = (counts[[f"{c}{k}" for k in np.flatnonzero(cut_)]].sum(axis=1).to_numpy(np.float64) for c in "pq")
        ratio = log_count_ratios(p[used], q[used], int(numbers[1, cut_].sum()), int(numbers[0, cut_].sum()), settings.smoothing)
        place = np.full(len(ids), -1)
        place[used] = np.arange(used.sum())
        own = cut_[part]
        theta, intercept = fit_logistic([(x := place[r])[x >= 0] for r, o in zip(rows, own) if o], y[own], ratio, settings)
        weights = np.zeros(len(ids))
        weights[used] = theta * ratio
        return weights, intercept

    weights, intercept = fitted(0, cuts[0])
    left_out = np.full(len(rows), np.nan)
    for j, cut_ in enumerate(cuts[1:], start=1):
        w, b = fitted(j, cut_)
        for i in np.flatnonzero(~cut_[part]):
            left_out[i] = w[rows[i]].sum() + b
    there = ~np.isnan(left_out)
    if 0 < y[there].sum() < there.sum():
        stands_for = np.array([sizes[0] / numbers[0].sum(), sizes[1] / numbers[1].sum()])
        intercept += np.log(settings.threshold / (1 - settings.threshold)) - best_cut(left_out[there], y[there], stands_for[y[there].astype(int)])
    full = np.zeros(1 << bits, dtype=np.float32)
    full[ids] = weights
    return Model(settings, intercept, full)


def best_cut(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The value between two z that parts the labels with the largest F1, in the widest gap of equals."""
    order = np.argsort(-z, kind="stable")
    z, hit, miss = z[order], np.cumsum((labels * weights)[order]), np.cumsum(((1 - labels) * weights)[order])
    f1 = 2 * hit / (hit + miss + hit[-1])
    gap = np.append(z[:-1] - z[1:], 0.0)
    f1 = np.where(gap > 0, f1, -1.0)
    if f1.max() < 0:
        return float(z[0])
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    at = best[gap[best].argmax()]
    return float((z[at] + z[at + 1]) / 2)


def score(df: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """df (or only its columns named in carry) with score and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 4 << bits bytes
    rest = without(df, "score", "predicted")
    carried = [f for f in rest.schema.fields if carry is None or f.name in carry]
    names, threshold = [f.name for f in carried], model.settings.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            s = np.array([own.score(t.as_py()) for t in batch.column(batch.schema.names.index(text_col))], dtype=np.float64)
            yield append_columns(batch.select(names), score=pa.array(s), predicted=pa.array((s >= threshold).astype(np.int32)))

    return map_arrow(rest, run, [*carried, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def learn_and_score(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = SETTINGS) -> DataFrame:
    """Id, held_out, score and predicted of every row; labels of held-out ids aren't learnt from.
    held_out is an expression over the id, by default CRC-32 of its text modulo 3 being 1."""
    held_out = F.coalesce(F.pmod(crc32_of_id(id_col), F.lit(3)) == 1 if held_out is None else held_out, F.lit(False))
    model = learn(docs, labels.where(~held_out), id_col, text_col, label_col, settings)
    return score(docs.select(id_col, held_out.alias("held_out"), text_col), model, text_col, carry=[id_col, "held_out"])
