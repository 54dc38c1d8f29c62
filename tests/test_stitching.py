from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vocaris.operators import stitching

RATE = 16000
TONES = [400.0, 1100.0, 2300.0]


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (4, 4), (3, 5), (5, 3)])
def test_assignment_is_the_cheapest(shape):
    rnd = np.random.default_rng(sum(shape))
    for _ in range(60):
        cost = np.round(rnd.normal(size=shape), 1)
        got = stitching.assignment(cost)
        used = [(i, j) for i, j in enumerate(got) if j >= 0]
        assert len(used) == min(shape) and len({j for _, j in used}) == len(used)
        wide = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
        assert sum(cost[i, j] for i, j in used) == pytest.approx(best)


class Tones:
    """Local speakers are the tones of a chunk, in an order that its sound decides."""

    def __call__(self, x):
        frames = x.reshape(-1, 160)
        t = np.arange(160) / RATE
        power = np.stack([np.abs(frames @ np.exp(-2j * np.pi * f * t)) * 2 / 160 for f in TONES], axis=1)
        order = np.random.default_rng(int(np.abs(x).sum())).permutation(3)
        return (power[:, order] > 0.1).astype(float)


def sound(parts, seconds):
    x = np.zeros(seconds * RATE)
    t = np.arange(len(x)) / RATE
    for tone, s, e in parts:
        x[int(s * RATE) : int(e * RATE)] += 0.25 * np.sin(2 * np.pi * TONES[tone] * t[int(s * RATE) : int(e * RATE)])
    return (x * 32767).astype(np.int16).tolist()


PARTS = {1: [(0, 0.5, 4.0), (1, 3.0, 7.0), (2, 6.0, 9.5), (0, 8.0, 12.0)], 2: [(0, 0.0, 3.0), (1, 0.0, 3.0)], 3: []}


def test_planted_overlapping_speakers_are_found(spark):
    rows = [(r, sound(p, 13 if r == 1 else 3)) for r, p in PARTS.items()] + [(4, [])]
    df = spark.createDataFrame(rows, "rec long, samples array<int>")
    config = stitching.StitchConfig(chunk=4.0, step=1.0, agreement=0.3)

    def voices(activity):
        """The share of each tone: here the model's order is known from the sound, so a voice is exact."""
        power = df.where("size(samples) > 0").select("rec", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("chunk"), "samples")

        def run(parts):
            for part in parts:
                out = []
                for rec, chunk, samples in zip(part.rec, part.chunk, part.samples):
                    x = np.asarray(samples, dtype=np.float32)[chunk * RATE : chunk * RATE + 4 * RATE] / 32768
                    if len(x) or chunk == 0:
                        x = np.pad(x, (0, 4 * RATE - len(x)))
                        order = np.random.default_rng(int(np.abs(x).sum())).permutation(3)
                        act = Tones()(x).sum(0)
                        out += [(rec, chunk, i, np.eye(3)[order[i]].tolist(), float(act[i])) for i in range(3)]
                yield pd.DataFrame(out, columns=["rec", "chunk", "i", "embedding", "weight"])

        return power.mapInPandas(run, "rec long, chunk int, i int, embedding array<double>, weight double")

    found = [tuple(r) for r in stitching.diarize_overlapping(df, Tones(), voices, config).collect()]
    for rec, parts in PARTS.items():
        own = sorted((s, e, label) for r, _, s, e, label in found if r == rec)
        want = sorted((s, e, tone) for tone, s, e in parts)
        assert len(own) == len(want)
        assert all(abs(a[0] - b[0]) <= 0.03 and abs(a[1] - b[1]) <= 0.03 for a, b in zip(own, want))
        names = {(a[2], b[2]) for a, b in zip(own, want)}
        assert len(names) == len({a for a, _ in names}) == len({b for _, b in names})
    assert not [r for r in found if r[0] == 4]
    # without voices, what a long silence separates are two tracks
    alone = [tuple(r) for r in stitching.diarize_overlapping(df, Tones(), None, config).where("rec = 1").collect()]
    assert len(alone) == 4 and len({r[4] for r in alone}) >= 3


def test_overlap_add_by_hand(spark):
    act = spark.createDataFrame([(1, 0, 0, [[1.0, 0.0], [1.0, 0.5], [0.0, 0.0]]), (1, 1, 1, [[0.2, 1.0], [0.0, 1.0], [0.0, 1.0]])], "rec long, chunk int, start long, act array<array<double>>")
    found = spark.createDataFrame([(1, 0, 0, 7), (1, 0, 1, 8), (1, 1, 0, 8), (1, 1, 1, 7)], "rec long, chunk int, i int, track long")
    got = {(r.track, r.f): round(r.p, 6) for r in stitching.overlap_add(act, found).collect()}
    # weights of three frames: 1/3, 2/3, 1/3
    assert got == {(7, 0): 1.0, (7, 1): 1.0, (7, 2): round(2 / 3, 6), (7, 3): 1.0, (8, 0): 0.0, (8, 1): round((2 / 3 * 0.5 + 1 / 3 * 0.2), 6), (8, 2): 0.0, (8, 3): 0.0}
    linked = stitching.links(act, 0.3).collect()
    assert [(r.chunk, r.i, r.j) for r in linked] == [(0, 0, 1)]
