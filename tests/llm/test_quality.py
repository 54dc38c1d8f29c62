import random
import re
from collections import Counter

from vocaris.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_counts_equal_brute_force(spark):
    rnd = random.Random(4)
    pieces = ["a", "bb", "été", "漢", "🙂", "#", "&|", "x y", " ", "\n", "\t", "\r\n", "\x0b", "\n\n", " "]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(120))) for _ in range(300)]
    texts += ["", None, " \n ", "same line\nsame line\n same line", "w " * 4000, "\n", "dup", "dup"]
    df = spark.createDataFrame([(i, t, "y", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, N_WORDS int")
    rows = quality.quality(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_bands_reject_repetition_and_noise_and_keep_prose(spark):
    rnd = random.Random(5)
    syllables = ["th", "er", "on", "an", "re", "in", "ed", "nd", "ha", "st", "ou", "ea", "ing", "ble", "wh"]
    vocabulary = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5))) for _ in range(4000)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    noise = lambda n: " ".join("".join(chr(rnd.randrange(33, 0x7F)) for _ in range(40)) for _ in range(n))
    line = prose(60)
    texts = [prose(60), prose(400), prose(5000), noise(100), noise(2000), " ".join(f"{line} {w}" for w in vocabulary[:40])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.quality(df).collect()} == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False}
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
    assert quality.quality(df.limit(0)).count() == 0


def test_bands_come_from_the_table_and_the_last_chunk_counts(spark):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9))) for _ in range(4000)]
    prose = lambda n, words: " ".join(rnd.choice(vocabulary[:words]) for _ in range(n))
    # 300 ordinary documents of one length class, and 12 of a tenth of the vocabulary, which the base rules keep
    texts = [prose(850, 4000)[:4800] for _ in range(300)] + [prose(850, 150)[:4800] for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality.quality(df).collect()
    assert not any(r.base_failed for r in rows)
    assert {r.doc_id for r in rows if not r.kept} >= set(range(300, 312))
    assert sum(r.kept for r in rows if r.doc_id < 300) >= 294
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {r.doc_id for r in rows if r.kept}
    # a full chunk of prose, then a nearly full one of noise
    noise = "".join(chr(rnd.randrange(33, 0x7F)) if k % 40 else " " for k in range(4000))
    mixed = spark.createDataFrame([(1, prose(900, 4000)[:4096] + noise)], "doc_id long, text string")
    assert quality.quality(mixed, bands=quality.BANDS).first().chunks_outside == 0.5
