"""Cases of voiceprint names, requests, votes, stores and search."""

import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocaris.functions import ids
from vocaris.operators import identify, requests, similarity, store

ORG, COLL = "64ff00000000000000000001", "65aa00000000000000000002"
NAME = f"spkid_{ORG}_{COLL}"


def test_point_ids_equal_uuid5(spark):
    names = ["label:" + ORG, "user:" + COLL, "é漢🙂", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.speaker_point_id(F.col("n")).alias("u"))
    assert {r.n: r.u for r in df.collect()} == {n: str(uuid.uuid5(uuid.UUID(ids.POINT_NAMESPACE), n)) for n in names}


def test_collection_names(spark):
    bad = ["", None, "spkid_123_456", NAME + "_extra", "other_" + NAME, f"spkid_{ORG.upper().replace('64FF', '64FF')}_{COLL}", f"spkid_{ORG}"]
    rows = spark.createDataFrame([(n,) for n in [NAME, *bad]], "n string").select("n", ids.parse_collection(F.col("n")).alias("x")).collect()
    assert [r.x.valid for r in rows] == [True] + [False] * len(bad)
    assert (rows[0].x.organization_id, rows[0].x.studio_collection_id) == (ORG, COLL)


VALID = [{"collections": [NAME]}, {"collections": [NAME], "speakers": "*"}, {"collections": [NAME], "speakers": None}, {"collections": [NAME], "speakers": []}, {"collections": [NAME], "speakers": ["label:x"], "minSimilarity": 0.8}, {"collections": [NAME], "minSimilarity": 1}]
INVALID = [
    {}, {"collections": []}, {"collections": NAME}, {"collections": [NAME], "other": 1}, {"collections": ["bad"]}, {"collections": [42]}, {"collections": [NAME], "speakers": "all"},
    {"collections": [NAME], "speakers": [42]}, {"collections": [NAME], "speakers": [""]}, {"collections": [NAME], "minSimilarity": "high"}, {"collections": [NAME], "minSimilarity": 1.5},
    {"collections": [NAME], "minSimilarity": -0.1}, {"collections": [NAME], "minSimilarity": True}, [NAME], 7,
]


def test_specs(spark):
    forms = [json.dumps(x) for x in VALID + INVALID] + ["not json", None]
    rows = requests.check_specs(spark.createDataFrame(list(enumerate(forms)), "id int, spec string")).orderBy("id").collect()
    assert [(r.spec, r.valid) for r in rows] == [(f, k < len(VALID)) for k, f in enumerate(forms)]
    assert [r.speakers for r in rows[:5]] == [None, None, None, [], ["label:x"]] and [r.min_similarity for r in rows[3:6]] == [None, 0.8, 1.0]


def test_speaker_lists(spark):
    known = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cid")], "pos int, name string")
    specs = spark.createDataFrame([(1, "*"), (2, "ann| zoe |"), (3, '[1, {"start": 2, "end": 3}]'), (4, '{"start": 3, "end": 4}'), (5, '["bob", ""]')], "id int, spec string")
    got = sorted((r.id, r.name, r.found) for r in requests.expand_speakers(specs, known).collect())
    assert got == [(1, "*", True), (2, "ann", True), (2, "zoe", False), (3, "ann", True), (3, "bob", True), (3, "cid", True), (4, "4", False), (4, "cid", True), (5, "bob", True)]


@pytest.mark.parametrize(("spec", "env", "want"), [(0.8, "0.3", 0.8), (None, "0.3", 0.3), (None, None, 0.5), (None, "", 0.5)])
def test_threshold(spark, spec, env, want):
    assert spark.range(1).select(identify.resolve_threshold(F.lit(spec).cast("double"), env).alias("x")).first().x == want


def winner(spark, hits, least=0.5, **lists):
    rows = [(1, k, float(s), i, n) for k, (s, i, n) in enumerate(hits)]
    df = spark.createDataFrame(rows, "query long, ord long, score double, speaker_id string, name string")
    lists = {k: spark.createDataFrame([(x,) for x in v], "speaker_id string") for k, v in lists.items()}
    r = identify.votes(df, least, queries=spark.createDataFrame([(1,)], "query long"), **lists).first()
    return r.speaker_id, r.name, None if r.votes is None else round(r.votes, 6)


def test_votes(spark):
    assert winner(spark, [(0.6, "a", "Alice"), (0.9, "b", "Bob"), (0.55, "a", "Alice")]) == ("a", "Alice", 1.15)
    assert winner(spark, [(0.4, "a", "Alice"), (0.6, "b", "Bob")]) == ("b", "Bob", 0.6)
    assert winner(spark, [(0.3, "a", "Alice")]) == (None, None, None)
    assert winner(spark, [(0.9, "a", "Alice"), (0.6, "b", "Bob")], allowed=["b"])[0] == "b"
    assert winner(spark, [(0.9, "a", "Alice"), (0.6, "b", "Bob")], allowed=[])[0] is None
    assert winner(spark, [(0.9, "a", "Alice"), (0.6, "b", "Bob")], excluded=["a"])[0] == "b"
    assert winner(spark, [(0.6, "a1", "Alice"), (0.55, "a2", "Alice"), (0.9, "b", "Bob")])[0] == "b"
    assert winner(spark, [(0.6, "a", "Alice (old)"), (0.8, "a", "Alice")]) == ("a", "Alice", 1.4)
    assert winner(spark, [(0.9, None, "X"), (0.6, "b", "Bob")])[0] == "b"
    assert winner(spark, [(0.6, "b", "Bob"), (0.6, "a", "Alice")])[0] == "b"
    assert winner(spark, [])[0] is None


def test_stats_and_exclusive_identification(spark):
    seg = spark.createDataFrame([(1, "s1", 1, 0.0, 5.0), (1, "s2", 2, 5.0, 7.0), (1, "s3", 3, 7.0, 8.0)], "rec long, spk string, seg int, s double, e double")
    names = spark.createDataFrame([(1, "s1", "Ann", 0.9), (1, "s2", "Ann", 0.7)], "rec long, spk string, name string, score double")
    got = {r.who: (r.duration, r.nbr_seg, r.spk_id_score) for r in identify.stats_by_name(seg, names).collect()}
    assert got == {"Ann": (7.0, 2, 0.7), "s3": (1.0, 1, None)}
    tags = spark.createDataFrame([(1, "s1", 9.0, 2), (1, "s2", 5.0, 1)], "rec long, spk string, total double, first int")
    hits = spark.createDataFrame([(1, "s1", 0, 0.9, "a", "Ann"), (1, "s2", 0, 0.95, "a", "Ann"), (1, "s2", 1, 0.6, "b", "Bob")], "rec long, spk string, ord int, score double, speaker_id string, name string")
    assert {r.spk: (r.speaker_id, r.votes) for r in identify.identify_exclusive(tags, hits, 0.5).collect()} == {"s1": ("a", 0.9), "s2": ("b", 0.6)}


def test_store(spark):
    none = spark.createDataFrame([], "collection string, dim int, distance string")
    name = spark.createDataFrame([("c",), ("c",)], "collection string")
    registry, flags = store.ensure(none, name)
    assert [r.created for r in flags.collect()] == [True] and registry.count() == 1
    assert [r.created for r in store.ensure(registry, name)[1].collect()] == [False]
    old = spark.createDataFrame([("c", "p", 1, "x"), ("c", "q", 1, "y")], "collection string, point_id string, updated_at int, model_id string")
    new = spark.createDataFrame([("c", "p", 1, "z")], old.schema)
    points = store.upsert(old, new)
    assert sorted((r.point_id, r.model_id) for r in points.collect()) == [("p", "z"), ("q", "y")]
    gone = spark.createDataFrame([("c", "p"), ("c", "p"), ("d", "p")], "collection string, point_id string")
    left, counts = store.delete(points, gone)
    assert [r.point_id for r in left.collect()] == ["q"] and {r.collection: r.deleted for r in counts.collect()} == {"c": 1, "d": 0}
    assert {r.deleted for r in store.delete(left, gone)[1].collect()} == {0}
    assert [r.existed for r in store.drop(left, name)[1].collect()] == [True] and store.drop(left, name)[0].count() == 0
    assert store.model_ids(points).first().model_id == "z"
    asked = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "collection string, pos int")
    there = spark.createDataFrame([("a",), ("b",), ("c",)], "collection string")
    models = spark.createDataFrame([("a", "m"), ("b", "other")], "collection string, model_id string")
    assert [r.collection for r in store.usable(asked, there, models, "m").orderBy("pos").collect()] == ["a", "c"]


def test_requests(spark):
    jobs = spark.createDataFrame([(0, 0), (2, 5), (None, 7), (0, None)], "speaker_count int, max_speaker int")
    assert [tuple(r) for r in requests.normalise_counts(jobs, 50).collect()] == [(None, 50), (2, None), (None, 7), (None, 50)]
    rows = spark.createDataFrame([("m", [0.0] * 3), ("x", [0.0] * 3), ("m", [0.0]), ("m", None)], "model_id string, vector array<float>")
    assert [r.error for r in requests.enrollable(rows, "m", 3).collect()] == [None, "model_mismatch", "bad_vector", "bad_vector"]
    clips = spark.createDataFrame([("a", 1, 100), ("a", 2, 200), ("b", 1, None), ("c", 1, 20)], "speaker string, pos int, samples long")
    got = {r.speaker: (r.duration_used, r.files_used, r.error) for r in requests.enrollment_audio(clips, 10, 25, 3).collect()}
    assert got == {"a": (25.0, 2, None), "b": (0.0, 0, "no_valid_audio"), "c": (2.0, 1, "audio_too_short")}


def test_search_equals_brute_force_over_tiles(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(700, 16))
    x[5] = x[6] = x[7]  # ties go to the smaller point
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "point long, vector array<float>, c int")
    queries = df.where("point % 50 = 0 or point = 7").select(F.col("point").alias("query"), "vector")
    monkeypatch.setattr(similarity, "TILE_POINTS", 200)
    y = x.astype(np.float32).astype(np.float64)
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    got = {}
    for r in similarity.top_k(queries, df).collect():
        got.setdefault(r.query, {})[r.rank] = r.point
    assert len(got) == 15
    for q, found in got.items():
        s = (u @ u[q]).round(12)
        assert [found[k] for k in range(1, 11)] == sorted(range(700), key=lambda i: (-s[i], i))[:10]
    per = similarity.top_k(queries, df, 2, partition="c").groupBy("query", "part").count().collect()
    assert len(per) == 45 and {r["count"] for r in per} == {2}


def test_planted_voiceprints_are_found(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(8, 192))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    enrolled = spark.createDataFrame([(i, v.tolist(), f"label:{i}", f"N{i}") for i, v in enumerate(base)], "point long, vector array<float>, speaker_id string, name string")
    trials = [(i, (base[i % 8] + 0.02 * rnd.normal(size=192)).tolist(), f"label:{i % 8}") for i in range(24)] + [(100 + i, rnd.normal(size=192).tolist(), None) for i in range(9)]
    df = spark.createDataFrame(trials, "query long, vector array<float>, speaker_id string")
    from vocaris.plans.pipelines import identify_speakers

    quality = identify.accuracy(df.select("query", "speaker_id"), identify_speakers(df.select("query", "vector"), enrolled)).first()
    assert quality.accuracy >= 0.9 and quality.rejection >= 0.9


def test_lookups_and_service_info(spark):
    points = spark.createDataFrame([("c", "1", "Ann"), ("c", "2", "Ann"), ("c", "3", "Bob"), ("d", "1", None)], "collection string, point_id string, name string")
    assert sorted((r.collection, r.name) for r in store.names(points).collect()) == [("c", "Ann"), ("c", "Bob")]
    asked = spark.createDataFrame([("c", "Ann"), ("c", "Bob"), ("d", "Ann")], "collection string, name string")
    assert {(r.collection, r.name): (r.point_id, r.found) for r in store.lookup_name(points, asked).collect()} == {("c", "Ann"): (None, 2), ("c", "Bob"): ("3", 1), ("d", "Ann"): (None, 0)}
    ids_ = spark.createDataFrame([("c", "3"), ("c", "9")], "collection string, point_id string")
    assert {r.point_id: r.name for r in store.lookup(points, ids_).collect()} == {"3": "Bob", "9": None}
    info = spark.createDataFrame([('{"a": "b", "x": "old"}',), ("[1]",), (None,)], "s string").select(store.service_info(F.col("s"), {"x": "new"}).alias("j"))
    assert [json.loads(r.j) for r in info.collect()] == [{"a": "b", "x": "new"}, {"x": "new"}, {"x": "new"}]
    built = spark.range(1).select(store.payload(F.lit(NAME), F.lit("user:1"), F.lit("Ann"), F.lit("m")).alias("p")).first().p
    assert (built.organization_id, built.studio_collection_id) == (ORG, COLL) and built.updated_at.endswith("+00:00")
