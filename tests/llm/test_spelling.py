import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vocaris.llm import spelling


def brute_words(rows, change=True):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if change and h % 97 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(words):
    form, out = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(v, w)]
        best = min(others, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(others))
    for w in words:
        end = w
        while form[end]:
            end = form[end]
        out[w] += (form[w], form[w] and words[form[w]], end)
    return out


def texts():
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abeé") for _ in range(rnd.randrange(4, 8))) for _ in range(60)]
    prefixed = ["prefix" + "".join(rnd.choice("abcd") for _ in range(3)) for _ in range(50)]
    rows = [(i, " ".join(rnd.choice(stems + prefixed).title() for _ in range(rnd.randrange(1, 120)))) for i in range(120)]
    return rows + [(900, None), (901, ""), (902, "Ëëëëë,ëëëëë-ËËËËË×ëëëëë 12 _" + "y" * 70_000), (903, "abababab " * 20_000), (903, "abababab"), (None, "zzzzz zzzzz zzzzz")]


@pytest.mark.parametrize("few", [1, 4, 10_000])
def test_groups_equal_brute_force(spark, few):
    rows = texts()
    settings = spelling.Settings(few=few, held=50)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"word": F.lit(1), "n": F.lit("x"), "key": F.lit(2)})
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group(spelling.count_words(df, spelling.damaged, settings), settings).collect()}
    want = brute_groups(brute_words([("null" if i is None else i, t) for i, t in rows]))
    assert got == want and any(v[2] for v in want.values()) and any(v[4] not in (w, v[2]) for w, v in want.items())


def test_pairs_come_once_and_crowded_keys_stay_linear(spark):
    rnd = random.Random(1)
    words = sorted({"shared" + "".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = sorted((min(r.a, r.b), max(r.a, r.b)) for r in spelling.near_pairs(df).collect())
    holes = Counter(w[:k] + "." + w[k + 1 :] for w in words for k in range(len(w)))
    assert len(got) == len(set(got)) == sum(n * (n - 1) // 2 for n in holes.values()) and all(near(a, b) for a, b in got)


def test_long_chains_and_empty_tables(spark):
    forms = spark.createDataFrame([(f"w{k:03}", f"w{k + 1:03}") for k in range(40)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w040"}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group(spelling.count_words(none)).count() == 0
