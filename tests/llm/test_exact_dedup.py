import hashlib
import random
import re
from collections import defaultdict

from vocaris.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for key, members in groups.items():
        members.sort(key=lambda m: (-len(m[1]), m[0]))
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [(i, members[0][0], len(members), j == 0, sha) for j, (i, _) in enumerate(members)]
    return sorted(out)


def made():
    rnd = random.Random(6)
    base = ["".join(rnd.choice("ab é漢🙂\n\t") for _ in range(rnd.randrange(30))) for _ in range(150)]
    texts = [rnd.choice(base) for _ in range(300)] + ["x" + " " * k + "y" for k in range(60)] + ["same"] * 200 + [None, "", " \n\t\x0b\x0c\r", "\xa0", "z" * 200_000]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    return rows


def test_decisions_equal_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, kept string, K int")
    for settings in (exact_dedup.SETTINGS, exact_dedup.Settings(bits_per_row=1, max_filter_bytes=4096), exact_dedup.Settings(bits_per_row=256, max_filter_bytes=4096, max_parts=2)):
        got = sorted(tuple(r) for r in exact_dedup.decide(df, settings=settings).collect())
        assert got == brute(rows)


def test_filter_lets_unique_rows_pass(spark):
    keys = spark.range(3000).selectExpr("cast(sha1(cast(id as string)) as binary) k").unionByName(spark.range(5).selectExpr("cast(sha1(cast(id as string)) as binary) k"))
    rows = exact_dedup.marked(keys, "k", *exact_dedup.repeated_filter(keys, "k"))
    maybe = rows.where("__maybe").count()
    assert 10 <= maybe < 200


def test_small_parts_still_let_unique_rows_pass(spark):
    # 64,000 rows need 128 KB: 8 times what one slice's filter may have, in parts of 4 KB
    settings = exact_dedup.Settings(max_filter_bytes=4096, max_parts=4)
    df = spark.range(64_000).selectExpr("id as doc_id", "concat('text ', id) as text").unionByName(spark.range(5).selectExpr("id as doc_id", "concat('text ', id) as text"))
    assert exact_dedup.slices_of(64_005, settings) == 8 and exact_dedup.filter_size(8000, settings)[1] == 4
    assert exact_dedup.decide(df, settings=settings).where("group_size = 2").count() == 10
    keys = df.select(exact_dedup.text_key("text").alias("k")).limit(8000)
    maybe = exact_dedup.marked(keys, "k", *exact_dedup.repeated_filter(keys, "k", settings)).where("__maybe").count()
    assert maybe < 400


def test_keep_one_returns_the_rows_that_stay(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, {"a": i}, "b") for i, t in rows], "doc_id long, text string, extra map<string,long>, __k string")
    kept = exact_dedup.keep_one(df)
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, k, _ in brute(rows) if k]


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (None, "a"), (2, "b"), (2, "b ")], "doc_id long, text string")
    got = exact_dedup.decide(df).collect()
    assert len(got) == 6 and sorted((r.doc_id, r.keep_id) for r in got if r.kept) == [(1, 1), (2, 2)]
    assert {r.group_size for r in got if r.keep_id == 1} == {4}
    assert sorted(tuple(r) for r in exact_dedup.keep_one(df).collect()) == [(1, "a"), (2, "b ")]
    assert exact_dedup.decide(df.limit(0)).count() == 0 and exact_dedup.keep_one(df.limit(0)).count() == 0
