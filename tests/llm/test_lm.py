import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocaris.llm import lm, ngram_trie
from vocaris.llm.elias_fano import EliasFano, encode


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0], [5, 5, 6, 1000, 2**40], list(range(300)), sorted(random.Random(1).sample(range(2**62), 5000)), sorted(random.Random(2).choices(range(50), k=70_000))])
def test_elias_fano_round_trip_and_successors(values):
    arrays = encode(np.array(values, dtype=np.uint64))
    ef = EliasFano(arrays)
    assert ef.decode().tolist() == values
    n = len(values)
    for lo, hi in ((0, n // 2), (n // 3, n), (n - 1, n), (n // 2, n // 2)):
        assert ef.decode(max(lo, 0), hi).tolist() == values[max(lo, 0) : hi]
    if values:
        assert [ef[k] for k in (0, n // 2, n - 1)] == [values[k] for k in (0, n // 2, n - 1)]
        wanted = sorted(random.Random(3).choices(values, k=20)) + [0, values[-1] + 1]
        at, same = ef.successors(np.array(wanted, dtype=np.uint64))
        assert [int(a) for a in at] == [next((k for k, v in enumerate(values) if v >= w), n) for w in wanted]
        assert [bool(x) for x in same] == [w in set(values) for w in wanted]
        bits = 8 * sum(arrays[x].nbytes for x in ("low", "high"))
        assert bits <= n * (3 + max(0, math.log2((values[-1] + 1) / n))) + 128


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [None]


def brute(rows, s):
    learnt = [tokens(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    total, vocabulary = sum(map(len, learnt)), {w for d in learnt for w in d}
    n = [Counter() for _ in range(s.order)]
    context = [Counter() for _ in range(s.order)]
    for d in learnt:
        padded = ["<"] * (s.order - 1) + d
        for at in range(s.order - 1, len(padded)):
            for k in range(s.order):
                n[k][tuple(padded[at - k : at + 1])] += 1
                context[k][tuple(padded[at - k : at])] += 1
    one = lambda w: (n[0][(w,)] + s.added) / (total + s.added * (len(vocabulary) + 1))

    def p(gram):
        up, down = s.mass * one(gram[-1]), s.mass
        for k in range(1, s.order):
            part = gram[s.order - 1 - k :]
            share = 1.0 if k == 1 else s.share
            up = n[k][part] + share * up
            down = context[k][part[:-1]] + (s.share if k > 1 else 1.0) * down
        return up / down

    out = []
    for i, t in rows:
        d = tokens(t)
        padded = ["<"] * (s.order - 1) + d
        grams = [tuple(padded[at - s.order + 1 : at + 1]) for at in range(s.order - 1, len(padded))]
        held = None if i is None else zlib.crc32(str(i).encode()) % 10 == 0
        out.append((i, held, len(d), sum((w,) in n[0] for w in d), total, sum(math.log10(one(w)) for w in d), sum(math.log10(p(g)) for g in grams)))
    assert all(abs(sum(p((*c, w)) for w in vocabulary) + p((*c, "unknown")) - 1) < 1e-9 for c in [("<",) * (s.order - 1), grams[0][1:], ("no",) * (s.order - 1)])
    return out


def made():
    rnd = random.Random(4)
    follow = defaultdict(lambda: [rnd.choice("abcdefghij") + rnd.choice("xyzé") for _ in range(4)])
    rows = []
    for i in range(150):
        w, text = "the", []
        for _ in range(rnd.randrange(1, 80)):
            w = "the" if rnd.random() < 0.33 else rnd.choice(follow[w])
            text.append(w.title() if rnd.random() < 0.2 else w)
        rows.append((i, " ".join(text)))
    rows += [(3, rows[3][1]), (200, None), (201, ""), (202, " \t\n"), (203, "long " * 30_000), (None, "no id at all"), (204, "unseen words; ÀÉ only")]
    return rows


@pytest.mark.parametrize("order,shard,hot,block", [(2, 2_000_000, 2048, 8 << 20), (2, 300, 4, 700), (3, 400, 6, 2000), (4, 10**6, 3, 1 << 20)])
def test_scores_equal_brute_force(spark, order, shard, hot, block):
    rows = made()
    settings = lm.Settings(ngram_trie.Smoothing(order=order, mass=20.0), shard, block, hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"score": F.lit("x"), "shard": F.lit(1), "held_out": F.lit(5)})
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    got = lm.learn_and_score(df, held_out, settings)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (-1 if r[0] is None else r[0])
    found, want = sorted(map(tuple, got.collect()), key=key), sorted(brute(rows, settings.smoothing), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in found], [r[5] for r in want], rtol=1e-9)
    assert all(abs(a[6] - b[6]) < 2e-4 * b[2] + 1e-3 for a, b in zip(found, want))


def test_trained_models_score_as_one_pass_does_and_better_than_single_words(spark):
    df = spark.createDataFrame(made(), "doc_id long, text string").repartition(4)
    settings = lm.Settings(ngram_trie.Smoothing(order=3, mass=20.0), 1000, 3000, 8)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    model = lm.train(df, ~held_out, settings)
    one = {r.doc_id: r for r in lm.learn_and_score(df, held_out, settings).collect() if r.doc_id not in (None, 3)}
    two = {r.doc_id: r for r in lm.score(df, model, ["doc_id"], settings).collect() if r.doc_id not in (None, 3)}
    assert all(abs(one[i].score - two[i].score) < 1e-4 and one[i].base_score == pytest.approx(two[i].base_score) for i in one)
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.learn_and_score(empty, held_out).count() == 0
    nothing = lm.learn_and_score(df, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in nothing)
