import dataclasses
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from vocaris.llm import toxicity
from vocaris.llm.textkernels import mix

SYLLABLES = ["ka", "no", "ri", "to", "mi", "sa", "el", "ur", "an", "ti"]
STEMS = ["grobb", "zwick", "pfuit"]


def made(seed, n, share=0.4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randrange(1, 5)))
    rows = []
    for i in range(n):
        toxic = rnd.random() < share
        words = [word() for _ in range(rnd.randrange(30, 400))]
        for _ in range(rnd.randrange(2, 6) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(STEMS) + rnd.choice(SYLLABLES))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def brute_features(text, s):
    if not text:
        return []
    clean = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
    while "\0\0" in clean:
        clean = clean.replace("\0\0", "\0")
    found = set()
    for n in s.sizes:
        for i in range(len(clean) - n + 1):
            code = 0
            for c in clean[i : i + n]:
                code = (code * 0x9E3779B97F4A7C15 + ord(c)) % (1 << 64)
            found.add(int(mix(np.array([(code + n) % (1 << 64)], dtype=np.uint64))[0]) >> (64 - s.bits))
    return sorted(found)


def test_features_equal_brute_force():
    rnd = random.Random(3)
    s = toxicity.SETTINGS
    for _ in range(100):
        text = "".join(rnd.choice("aBé 1.漢") for _ in range(rnd.randrange(30)))
        assert toxicity.features(text, s).tolist() == brute_features(text, s), text


def brute_scores(rows, learnt, s):
    """Scores of all rows by dense matrices, learning from those of the ids in learnt."""
    has = np.zeros((len(rows), 1 << s.bits))
    for k, (_, t, _) in enumerate(rows):
        has[k, brute_features(t, s)] = 1
    y = np.array([r[2] for r in rows], dtype=float)
    own = np.array([r[0] in learnt for r in rows])
    p, q, n, m = has[own & (y == 1)].sum(0), has[own & (y == 0)].sum(0), (own & (y == 1)).sum(), (own & (y == 0)).sum()
    both = (p + q) / (n + m)
    z = (p / n - q / m) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n + 1 / m))
    used = (p + q >= s.least_texts) & (np.abs(z) >= s.least_z)
    ratio = np.log((p + s.smoothing) / (n + 2 * s.smoothing)) - np.log((q + s.smoothing) / (m + 2 * s.smoothing))
    x = (has * ratio)[:, used]
    share = np.where(y == 1, 0.5 / n, 0.5 / m)
    w, b = np.zeros(x.shape[1]), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, s.steps + 1):
        error = ((1 / (1 + np.exp(-(x @ w + b))) - y) * share)[own]
        grad = np.append(x[own].T @ error + s.penalty * w, error.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return 1 / (1 + np.exp(-(x @ w + b)))


def test_scores_equal_brute_force(spark):
    s = dataclasses.replace(toxicity.SETTINGS, bits=12, steps=40, folds=0)
    rows = [(i, t[:300], y) for i, t, y in made(7, 90)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.learn_and_score(docs, labels, settings=s).collect()}
    learnt = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {i for i, r in got.items() if not r.held_out} == learnt
    assert np.allclose([got[i].score for i, _, _ in rows], brute_scores(rows, learnt, s), atol=1e-4)


def test_the_intercept_is_set_by_left_out_rows(spark):
    """The shift equals that of fits by brute force with each part left out."""
    s = dataclasses.replace(toxicity.SETTINGS, bits=12, steps=40, least_z=2.5)
    rows = [(i, t[:400], y) for i, t, y in made(11, 120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    parts = {r.doc_id: r.k for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(s.seed + 1)), F.lit(3)).alias("k")).collect()}
    logit = lambda p: np.log(p / (1 - p))
    z = np.zeros(len(rows))
    for k in range(3):
        scores = brute_scores(rows, {i for i in parts if parts[i] != k}, s)
        own = [j for j, r in enumerate(rows) if parts[r[0]] == k]
        z[own] = logit(scores[own])
    want = logit(0.7) - toxicity.best_cut(z, np.array([r[2] for r in rows], dtype=float), np.ones(len(rows)))
    model, plain = (toxicity.learn(docs, labels, settings=x) for x in (s, dataclasses.replace(s, folds=0)))
    assert np.isclose(model.intercept - plain.intercept, want, atol=1e-3) and np.allclose(model.weights, plain.weights, atol=1e-5)


def test_best_cut_by_hand():
    z, y = np.array([3.0, 2.0, 1.0, 0.0, -1.0]), np.array([1.0, 1, 0, 1, 0])
    assert toxicity.best_cut(z, y, np.ones(5)) == -0.5  # 3 hits and 1 miss: F1 6/7
    assert toxicity.best_cut(z, y, np.where(y == 1, 1.0, 10.0)) == 1.5  # a clean row stands for ten
    assert toxicity.best_cut(np.array([9.0, 8, 1, 0]), np.array([1.0, 1, 0, 0]), np.ones(4)) == 4.5
    assert toxicity.best_cut(np.array([1.0, 1.0]), np.array([1.0, 0]), np.ones(2)) == 1.0


def test_sample_is_bounded_in_rows(spark):
    rows = made(8, 150)
    hot = [(0, f"{t} {k}") for k, (_, t, _) in enumerate(rows)] * 3
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    one = spark.createDataFrame([(rows[0][1],), *[(t,) for _, t in hot]], "t string").orderBy(F.xxhash64("t")).first().t
    texts = {i: t for i, t, _ in rows}
    alone = spark.createDataFrame([(i, one if i == 0 else t) for i, t in texts.items()], "doc_id long, text string")
    many = spark.createDataFrame([(i, t) for i, t in texts.items()] + hot, "doc_id long, text string")
    a, b = (toxicity.learn(df, labels) for df in (alone, many))
    assert a.intercept == b.intercept and np.array_equal(a.weights, b.weights)


def test_ratio_and_significance_by_hand(spark):
    r = toxicity.log_count_ratios(np.array([3.0, 0.0]), np.array([0.0, 3.0]), 6, 6, 1.0)
    assert np.allclose(r, [np.log(4), -np.log(4)])
    df = spark.createDataFrame([(3, 0), (2, 2)], "p long, q long").select(toxicity.significance(F.col("p"), F.col("q"), 6, 6).alias("z"))
    assert np.allclose([r.z for r in df.collect()], [0.5 / np.sqrt(0.25 * 0.75 / 3), 0])


def test_held_out_accuracy(spark):
    rows = made(1, 500)
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in rows], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = toxicity.learn_and_score(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out]
    assert len(out) == 500 and 100 < len(held) < 240
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)


def test_edges(spark):
    rows = made(2, 120) + [(900, None, 0), (901, "", 0), (902, "ka no " * 40000, 0), (903, "kano", 0), (903, "kano", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.learn_and_score(docs, labels).collect()}
    assert got[900].score == got[901].score and all(got[i].predicted == 0 for i in (900, 901, 902, 903))
    none = toxicity.learn_and_score(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.0}
    assert toxicity.learn_and_score(docs.limit(0), labels).count() == 0
