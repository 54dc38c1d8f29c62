import math
import random

import pytest
from pyspark.sql import functions as F

from vocaris.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        kept[i] = min(kept.get(i, (label, q)), (label, q))
    out = []
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, (_, w) in kept.items() if i != a and len(w) == len(v))
        for minus, p in [x for x in ranked if kept[x[1]][0] == label][:5]:
            hits = [(m, n) for m, n in ranked if kept[n][0] != label and 30 * -minus <= 100 * -m <= 90 * -minus][:10]
            out += [(a, p, k + 1, n, -minus, -m) for k, (m, n) in enumerate(hits)]
    return sorted(out)


def made(n=700, dims=6):
    rnd = random.Random(2)
    # few values a component, so that scores tie
    rows = [(i, rnd.randrange(4), [rnd.choice([-0.5, -0.25, 0.0, 0.125, 0.5, 0.7]) for _ in range(dims)]) for i in range(n)]
    rows += [(i, 1, [0.5] * dims) for i in range(1000, 1200)]  # copies
    rows += [(100, 0, [0.1] * dims), (100, 0, [0.1] * dims), (7, 3, [9.0] * dims)]  # repeated ids
    rows += [(1300, None, [0.1] * dims), (1400, 1, None), (1500, 1, [float("nan")] * dims), (1501, 1, [float("inf")] * dims), (1502, 1, [None] * dims), (None, 1, [0.1] * dims)]
    return rows + [(1600, 2, [0.5, 0.5]), (1601, 2, [0.5, 0.25]), (1602, 1, [0.25, 0.25]), (1700, 9, [1.0] * dims), (1800, 1, [])]


@pytest.mark.parametrize("settings", [negatives.SETTINGS, negatives.Settings(tile=60, least_tile=50, block=3, strip_cells=200)])
def test_negatives_equal_brute_force(spark, settings):
    rows = made()
    df = spark.createDataFrame([r + ("x", 1) for r in rows], SCHEMA + ", id string, score int").repartition(3)
    got = negatives.mine(df, F.col("id") % 100 == 0, settings)
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_empty_table_and_large_components(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("id") % 100 == 0).count() == 0
    rows = [(0, 1, [3e6, 1.0]), (1, 1, [3e6, 2.0]), (2, 2, [2e6, 1.0]), (3, 2, [2e6, 1.5])]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows) != []
