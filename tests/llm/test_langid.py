import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vocaris.llm import langid
from vocaris.llm.frames import crc32_of_id


def brute_grams(text, max_n):
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    out = Counter()
    for w in words:
        out.update(w)
        padded = f"\x01{w}\x01"
        for n in range(2, max_n + 1):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return out


def as_key(gram):
    key = 0
    for c in gram:
        key = key << 21 | ord(c)
    return key


def test_gram_counts_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("abÉé 漢1.\n🙂İ") for _ in range(rnd.randrange(40)))
        keys, counts = langid.gram_counts(text, 3)
        assert dict(zip(keys.tolist(), counts.tolist())) == {as_key(g): n for g, n in brute_grams(text, 3).items()}, text


def test_out_of_place_distance_by_hand():
    settings = langid.Settings(profile=3, max_n=1)
    profiles = langid.Profiles({"x": np.array([ord(c) for c in "abc"], np.uint64), "y": np.array([ord(c) for c in "cba"], np.uint64)}, settings)
    # "aab" ranks a, b; x differs by 0, y by 2 + 0
    assert profiles.predict("aab") == ("x", 1.0)
    assert profiles.predict("zz") == ("x", 0.0)
    assert profiles.predict("1 2") == ("und", 0.0) and profiles.predict(None) == ("und", 0.0)


def test_held_out_accuracy_and_edges(spark):
    rnd = random.Random(2)
    syllables = {"aa": ["ka", "no", "ri", "to"], "bb": ["str", "ing", "est", "th"], "cc": ["ção", "ão", "inho", "lh"]}
    rows = [(i, " ".join("".join(rnd.choice(syllables[x]) for _ in range(rnd.randrange(1, 4))) for _ in range(30)), x, "s", 0) for i, x in enumerate(sorted(syllables) * 60)]
    rows += [(900, None, "aa", "s", 0), (901, "", None, "s", 0), (902, "12 !?", "bb", None, 0), (903, "ka " * 30000, None, "s", 0), (904, "kano", "aa", "s", 0), (904, "kano", "aa", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    out = langid.learn_and_identify(df, F.pmod(crc32_of_id(), F.lit(4)) == 2).collect()
    assert len(out) == len(rows)
    want = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in out if r.doc_id < 900)
    got = {r.doc_id: r for r in out}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "aa" and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in langid.learn_and_identify(df.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()} == {"und"}
    assert langid.learn_and_identify(df.limit(0), F.lit(False)).count() == 0


def test_every_language_of_a_large_table_has_its_profile(spark):
    # 120 million characters of one language, and one short document of each of 20 others
    common = spark.range(120, numPartitions=4).select(F.col("id").alias("doc_id"), F.expr("repeat('kano rito ', 100000)").alias("text"), F.lit("aa").alias("lang"))
    word = lambda k: "".join(chr(0x4E00 + 10 * k + j) for j in range(6))
    rare = spark.createDataFrame([(1000 + k, word(k), f"r{k:02}") for k in range(20)], "doc_id long, text string, lang string")
    profiles = langid.learn(common.union(rare))
    assert profiles.languages == ["aa"] + [f"r{k:02}" for k in range(20)]
    assert [profiles.predict(word(k) * 2)[0] for k in range(20)] == [f"r{k:02}" for k in range(20)]
