import random
import re
from collections import Counter, defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from vocaris.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: [(source, words)] in order."""
    total, full = sum(n for _, n in sizes), {}
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    while True:
        rest = total - sum(full.values())
        open_ = {s: rest * w[s] / sum(w[t] for t in w if t not in full) for s in w if s not in full}
        new = {s: cap * n for s, n in sizes if s in open_ and open_[s] > cap * n}
        if not new:
            return full | open_
        full |= new


def made(n=3000):
    rnd = random.Random(9)
    sources = ["a", "B", "é", "漢", "🙂", None, "zz", "empty"]
    rows = []
    for i in range(n):
        s = rnd.choices(sources, [50, 5, 10, 1, 3, 20, 10, 0])[0]
        rows.append((i, " ".join("w" * rnd.randrange(1, 4) for _ in range(min(2000, int(rnd.paretovariate(0.9)) * 5))) + rnd.choice(["", " ", "\n"]), s))
    rows += [(n, None, "a"), (n + 1, "", "a"), (n + 2, " \n", "empty"), (7, "dup dup", "a"), (7, "dup dup", "a"), (7, "dup dup", "a"), (None, "x y", None)]
    return rows


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_sizes_and_rounding(spark):
    rows = made()
    df = spark.createDataFrame([(*r, "q", 3) for r in rows], "doc_id long, text string, source string, target string, SIZE int")
    for block in (8, 64, 1024):
        settings = mixing.Settings(block=block)
        got = mixing.decide(df, settings=settings).collect()
        assert len(got) == len(rows)
        sizes = defaultdict(int)
        for _, t, s in rows:
            sizes[s] += words(t)
        order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
        want = brute_targets([(s, sizes[s]) for s in order])
        taken, smallest = defaultdict(int), defaultdict(list)
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
            assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
            taken[r.source] += r.taken
            smallest[r.source] += [r.size] * (r.size > 0)
        for s in sizes:
            # one document is decided alone; of many it is a small one
            off = abs(taken[s] - want[s])
            assert off <= max(smallest[s], default=0) + 1e-6
            if block == 1024 and len(smallest[s]) > 200:
                assert off <= 0.01 * want[s]
        assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, _ in rows)
    # in another order, and by salted keys
    again = mixing.decide(df.repartition(7), settings=replace(settings, most_broadcast=0, salts=5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


@pytest.mark.parametrize("share,block", [(0.7, 1024), (0.986, 1024), (0.35, 2), (0.5, 3)])
def test_every_document_keeps_its_rate(spark, share, block):
    """Four hundred sources alike are as many trials: each document's mean copies are its source's rate, though
    sizes differ tenfold and one document has a third of all words; and sums stay near their targets."""
    sizes, trials = [50, 40, 30, 20, 10, 5, 3, 2], 400
    df = spark.createDataFrame([(100 * t + k, "w " * n, f"s{t:03}") for t in range(trials) for k, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = mixing.decide(df, settings=mixing.Settings(weights=(1,), share=share, block=block)).collect()
    total, taken = defaultdict(float), defaultdict(int)
    for r in got:
        assert abs(r.target / r.source_size - share) < 1e-9
        total[r.doc_id % 100] += r.copies
        taken[r.source] += r.taken
    error = (share * (1 - share) / trials) ** 0.5
    assert all(abs(n / trials - share) <= 4 * error for n in total.values())
    spread = (sum((n - share * sum(sizes)) ** 2 for n in taken.values()) / trials) ** 0.5
    alone = (share * (1 - share) * sum(n * n for n in sizes)) ** 0.5  # of independent choices
    assert spread < alone * (0.35 if block > 8 and share == 0.7 else 0.95) and abs(sum(taken.values()) / trials - share * sum(sizes)) <= 4 * spread / trials**0.5


def test_mix_takes_the_decided_copies(spark):
    df = spark.createDataFrame([(*r, "e") for r in made(400)], "doc_id long, text string, source string, __row string")
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    want = Counter()
    for r in mixing.decide(df).where("taken > 0").collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == want


def test_very_long_text_null_ids_and_moved_rows(spark):
    rows = [(k, "w " * (5 + k % 40), "ab"[k % 2]) for k in range(400)] + [(400, "long " * 300_000, "a"), (None, "x y z", "a"), (None, "x y z", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.decide(df).collect()
    size = {r.doc_id: r.size for r in got}
    assert len(got) == len(rows) and size[400] == 300_000 and size[None] == 3
    own = {s: [r for r in got if r.source == s] for s in "ab"}
    assert abs(sum(r.taken for r in own["b"]) - own["b"][0].target) <= 6
    # one document has nearly all words of its source: it is decided alone, in favour of its rate
    assert abs(sum(r.taken for r in own["a"]) - own["a"][0].target) <= 300_000
    want = Counter()
    for r in got:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.mix(df).collect()) == +want


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.doc_id, r.size, r.taken, r.target) for r in mixing.decide(df).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    assert mixing.decide(df.limit(0)).count() == 0 and mixing.mix(df).count() == 0
