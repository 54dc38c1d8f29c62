import hashlib
import random
from collections import defaultdict

from vocaris.llm import suffix_dedup
from vocaris.llm.anchors import Settings


def brute(rows, length):
    seen = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] += 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, length):
    rnd = random.Random(seed)
    syllables = ["th", "er", "on", "é", "an", "re", " ", "in", "漢", "ing ", "st", ". ", "\n"]
    prose = lambda n: "".join(rnd.choice(syllables) for _ in range(n))
    passages = [prose(n) for n in (length // 2, length // 2, length, length, 2 * length, 4 * length)]
    # passages of about the limit, and exact ones
    edge = "".join(rnd.choice("abcdefgh") for _ in range(length + 3))
    texts = []
    for _ in range(60):
        parts = [prose(rnd.randrange(0, length))]
        for _ in range(rnd.randrange(0, 4)):
            p = rnd.choice(passages + [edge[: length - 1], edge[:length], edge[1 : length + 1], edge])
            k = rnd.random()
            if k < 0.3:
                at = rnd.randrange(len(p))
                p = p[:at] + rnd.choice(["X", "", "é"]) + p[at + 1 :]
            elif k < 0.5:
                p = p[rnd.randrange(len(p) // 3) :]
            parts += [p, prose(rnd.randrange(0, length // 2))]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], texts[5] + "tail", "ab" * (2 * length), "z" * (length - 1), "z" * length, "q" * (length + 1), (prose(20) + "\n") * 30, None, "", "short"]
    return list(enumerate(texts))


def got(df, **more):
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, digest=True, **more).collect()), key=str)


def test_equals_brute_force(spark):
    for seed, settings in ((1, Settings(length=60, gram=20, step=5)), (2, Settings(length=60, gram=28, step=4, shard_bytes=3000)), (3, Settings(length=60, gram=20, step=5, most_contexts=2))):
        rows = made(seed, 60)
        df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kept string, V int")
        assert got(df, settings=settings) == brute(rows, 60)


def test_production_length_and_outputs(spark):
    rows = made(4, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 200)
    assert got(df) == want
    out = suffix_dedup.remove_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(x.e - x.s for x in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out), key=str) == want


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a" + "xy" * 150), (1, "a" + "xy" * 150), (2, None), (None, "m" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows, 200)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
