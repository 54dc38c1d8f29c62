import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocaris.operators import clustering, identify, similarity, store, turns, vad
from vocaris.operators.requests import step_samples
from vocaris.plans import recordings as R
from vocaris.plans.pipelines import DiarizeConfig
from vocaris.settings import Settings
from vocaris.sources import audio

RATE = 16000
PITCH = {"ann": 300, "bob": 700, "cid": 1300, "dora": 2100, "eve": 3100, "imp": 4700, "imq": 5600}


def tone(name, seconds, seed=0):
    t = np.arange(int(seconds * RATE)) / RATE
    x = np.sin(2 * np.pi * PITCH[name] * t) + 0.4 * np.sin(4 * np.pi * PITCH[name] * t) + np.random.default_rng(seed).normal(size=len(t)) * 0.02
    return (6000 * x).astype(np.int16)


def silence(seconds):
    return np.zeros(int(seconds * RATE), np.int16)


def speech(x):
    return float(np.sqrt((x**2).mean()) > 0.02)


def voice(x):
    power = np.abs(np.fft.rfft(x)) ** 2
    bands = np.add.reduceat(power, np.linspace(0, len(power) - 1, 33).astype(int)[:-1])
    return np.sqrt(bands / max(bands.sum(), 1e-12)).astype(np.float32)


@pytest.fixture(scope="module")
def spoken(spark, tmp_path_factory):
    """WAV files of two speakers each, read back; and who spoke when."""
    folder = tmp_path_factory.mktemp("wavs")
    truth, rows = [], []
    for k, (a, b) in enumerate([("ann", "bob"), ("cid", "dora"), ("eve", "ann"), ("imp", "bob"), ("imq", "cid")]):
        parts = [silence(1)]
        for seed, name in enumerate((a, b, a)):
            truth.append((f"r{k}", name, len(np.concatenate(parts)) / RATE))
            parts += [tone(name, 6, 10 * k + seed), silence(1.5)]
        rows.append((f"r{k}", np.concatenate(parts).tolist()))
    audio.write_wavs(spark.createDataFrame(rows, "name string, samples array<int>").withColumn("samples", F.col("samples").cast("array<smallint>")), str(folder)).collect()
    return audio.read(spark, str(folder)), truth


def named(df):
    return df.withColumn("name", F.regexp_extract("path", r"(r\d+)\.wav$", 1))


def points(spark):
    clips = [(n, p, tone(n, 2, 50 + p).tolist()) for n in ("ann", "bob", "cid", "dora", "eve") for p in range(3)] + [("short", 0, silence(1).tolist()), ("none", 0, None)]
    prints = R.voiceprints(spark.createDataFrame(clips, "speaker string, pos int, samples array<smallint>"), voice, "m1")
    return prints


def test_voiceprints(spark):
    got = {r.speaker: r for r in points(spark).collect()}
    assert got["ann"].files_used == 3 and got["ann"].duration_used == 6.0 and got["ann"].dim == 32 == len(got["ann"].vector) and got["ann"].error is None
    assert got["short"].error == "audio_too_short" and got["short"].vector is None and got["none"].error == "no_valid_audio"
    some = spark.createDataFrame([("a", p, tone("ann", 2).tolist()) for p in range(3)], "speaker string, pos int, samples array<smallint>")
    cut = R.voiceprints(some, voice, "m1", most=5).first()
    assert cut.duration_used == 5.0 and cut.files_used == 3


def test_from_wav_to_identified_speakers(spark, spoken):
    recordings, truth = spoken
    found = R.diarize_audio(recordings, speech, voice, DiarizeConfig(speakers=2)).cache()
    names = {r.rec: r.name for r in named(R.with_rec(recordings)).select("rec", "name").collect()}
    turns_ = [(names[r.rec], r.label, r.s, r.e) for r in found.collect()]
    assert len({(n, label) for n, label, _, _ in turns_}) == 10
    for rec, _, start in truth:
        assert any(n == rec and s <= start + 1 and e >= start + 4 for n, _, s, e in turns_)
    known = points(spark).where("error is null").select(F.xxhash64("speaker").alias("point"), "vector", F.col("speaker").alias("speaker_id"), F.col("speaker").alias("name"))
    for twice in (True, False):
        who = R.identify_recordings(recordings, found, known, voice, 0.8, twice=twice)
        by_tag = {(names[r.rec], r.spk): r.name for r in who.collect()}
        right = total = rejected = impostors = 0
        for rec, name, start in truth:
            tag = next(label for n, label, s, e in turns_ if n == rec and s <= start + 3 <= e)
            if name.startswith("im"):
                impostors, rejected = impostors + 1, rejected + ((rec, tag) not in by_tag)
            else:
                total, right = total + 1, right + (by_tag.get((rec, tag)) == name)
        assert right / total >= 0.9 and rejected / impostors >= 0.9


def test_jobs_use_the_cache(spark, spoken):
    recordings, _ = spoken
    withc = recordings.join(spark.read.format("binaryFile").load(recordings.first().path.rsplit("/", 1)[0]).select("path", "content"), "path").where("path like '%r0.wav' or path like '%r1.wav'")
    out, cache = R.run_jobs(withc, speech, voice, config=DiarizeConfig(speakers=2))
    got = out.collect()
    assert len(got) == 2 and all({s["spk_id"] for s in json.loads(r.result)["segments"]} == {"spk1", "spk2"} for r in got)
    old = spark.createDataFrame([(r.key, "kept") for r in cache.collect()], "key string, result string")
    again, _ = R.run_jobs(withc, speech, voice, cache=old, config=DiarizeConfig(speakers=2))
    assert {r.result for r in again.collect()} == {"kept"}


def test_enroll_reports_each_point(spark):
    good = "spkid_" + "a" * 24 + "_" + "b" * 24
    new = spark.createDataFrame([(good, "label:1", "Ann", [1.0, 0.0], "m", "2"), (good, "label:2", "Bob", [1.0], "m", "2"), (good, "label:3", "Cid", [1.0, 0.0], "x", "2"), ("bad", "label:4", "Eve", [1.0, 0.0], "m", "2")], "collection string, speaker_id string, name string, vector array<double>, model_id string, updated_at string")
    ids = new.withColumn("point_id", F.lit("")).limit(0)
    known = spark.createDataFrame([], "collection string, dim int, distance string")
    after, collections, status = store.enroll(ids, known, new, "m", 2)
    assert [r.name for r in after.collect()] == ["Ann"] and [r.collection for r in collections.collect()] == [good]
    assert sorted((r.status, r.created_collection, r.error or "") for r in status.collect()) == [("refused", False, "bad_collection"), ("refused", False, "bad_vector"), ("refused", False, "model_mismatch"), ("stored", True, "")]
    _, _, again = store.enroll(after, collections, new.where("name = 'Ann'"), "m", 2)
    assert [(r.status, r.created_collection) for r in again.collect()] == [("stored", False)]


def test_frame_speech_checks_its_arguments(spark):
    df = spark.createDataFrame([("a", tone("ann", 0.1).tolist() + [0] * 1000), ("b", None)], "path string, samples array<smallint>")
    got = audio.frame_speech(df, lambda b, rate: np.frombuffer(b, "<i2").any()).orderBy("i").collect()
    assert [r.speech for r in got] == [1, 1, 1, 1, 0, 0] and {r.path for r in got} == {"a"}
    for bad in ({"rate": 44100}, {"hop": 25}, {"mode": 4}):
        with pytest.raises(ValueError):
            audio.frame_speech(df, speech, **bad)
    assert audio.as_int16(np.array([1.0, -1.0, 0.0])).tolist() == [32767, -32767, 0] and audio.as_int16(np.array([2**31 - 1], np.int32)).tolist() == [32767]


def test_settings():
    s = Settings.of({"service": "x", "min_similarity": "", "window_step": "0.25", "identify_twice": "0"})
    assert s.queue == "x" and s.min_similarity is None and not s.identify_twice and s.step_samples(1000) == 250 and not s.can_identify
    for bad in ({"window_step": "0"}, {"window_step": "2"}, {"least_enrollment": "three"}):
        with pytest.raises(ValueError):
            Settings.of(bad)
    for guard in (s.require_store, s.require_legacy_collection):
        with pytest.raises(RuntimeError):
            guard()
    assert Settings.of({"store": "s", "legacy_collection": "c"}).require_legacy_collection() == "c"


def test_settings_of_a_session(spark):
    spark.conf.set("spark.vocaris.queue", "q7")
    try:
        assert Settings.of_session(spark).queue == "q7" and Settings.of_session(spark).service == "diarization"
    finally:
        spark.conf.unset("spark.vocaris.queue")


def test_small_operators(spark):
    keys = spark.createDataFrame([(1, 0, [1, 2]), (1, 1, [2, 3]), (1, 2, [])], "rec int, k int, bits array<int>")
    assert {(r.i, r.j): round(r.w, 3) for r in similarity.jaccard(keys).collect()}[0, 1] == 0.333
    graph = spark.createDataFrame([(1, 0, 1, 4.0), (1, 1, 0, 4.0), (1, 0, 0, 9.0), (1, 2, 2, 1.0)], "rec int, i int, j int, w double")
    assert sorted((r.i, r.j, r.w) for r in similarity.laplacian_normalised(graph).collect()) == [(0, 0, 1.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 1.0), (2, 2, 0.0)]
    seg = spark.createDataFrame([(1, 0, 0.0, 2.5, 1), (1, 1, 2.5, 1.0, 2), (1, 2, 3.5, -1.0, -1)], "rec int, seg int, start double, duration double, label int")
    assert [(r.s, r.e, r.label) for r in turns.of_legacy(seg).orderBy("seg").collect()] == [(0.0, 2.5, "1"), (2.5, 3.5, "2")]
    f = spark.range(6).selectExpr("1 rec", "id i")
    assert [r.speech for r in vad.mask_of_seconds(f, spark.createDataFrame([(1, 0.012, 0.039)], "rec int, s double, e double")).orderBy("i").collect()] == [0, 1, 1, 1, 0, 0]
    assert f.select(step_samples(F.lit(0.5), F.lit(9)).alias("x")).first().x == 4
    hits = spark.createDataFrame([(1, "b", 0.9, 1), (1, "a", 0.5, 2), (1, "a", 0.7, 3)], "query int, collection string, score double, point int")
    order = identify.in_collection_order(hits, spark.createDataFrame([("a", 0), ("b", 1)], "collection string, pos int"))
    assert {r.point: r.ord for r in order.collect()} == {3: 1, 2: 2, 1: 3}


def test_normalised_embedding_parts_blocks():
    rng = np.random.default_rng(2)
    a = np.kron(np.eye(3), np.ones((5, 5))) + rng.random((15, 15)) * 0.01
    found = clustering.k_means(clustering.normalised_embedding(a, 3), 3)
    assert len(set(found)) == 3 and all(len(set(found[k : k + 5])) == 1 for k in (0, 5, 10))


def test_top_k_over_tiles_chunks_and_strips(spark, monkeypatch):
    for name, value in (("TILE_POINTS", 40), ("CHUNK_QUERIES", 16), ("STRIP_CELLS", 64)):
        monkeypatch.setattr(similarity, name, value)
    rng = np.random.default_rng(5)
    p, q = rng.integers(-2, 3, (150, 4)).astype(float), rng.integers(-2, 3, (50, 4)).astype(float)
    p[:, 0] += 0.5
    q[:, 0] += 0.5
    points_ = spark.createDataFrame([(k, v.tolist(), "ab"[k % 2]) for k, v in enumerate(p)], "point long, vector array<double>, part string")
    got = similarity.top_k(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "query long, vector array<double>"), points_, 5, partition="part").collect()
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T
    want = set()
    for k in range(50):
        for part in range(2):
            own = [j for j in range(150) if j % 2 == part]
            want |= {(k, j, r + 1) for r, j in enumerate(sorted(own, key=lambda j: (-round(cos[k, j], 12), j))[:5])}
    assert {(r.query, r.point, r["rank"]) for r in got} == want


class Counted:
    """A model that leaves a byte for every call."""

    def __init__(self, model, path):
        self.model, self.path = model, str(path)

    def __call__(self, x):
        with open(self.path, "ab") as log:
            log.write(b".")
        return self.model(x)


def test_models_run_once_in_a_run_of_jobs(spark, spoken, tmp_path):
    recordings, _ = spoken
    one = recordings.join(spark.read.format("binaryFile").load(recordings.first().path.rsplit("/", 1)[0]).select("path", "content"), "path").where("path like '%r0.wav'")
    one.write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    known = points(spark).where("error is null").select(F.xxhash64("speaker").alias("point"), "vector", F.col("speaker").alias("speaker_id"), F.col("speaker").alias("name"))
    known.write.parquet(str(tmp_path / "known"))
    heard, voiced = Counted(speech, tmp_path / "speech"), Counted(voice, tmp_path / "voice")
    windows = R.embedded_windows(one, speech, voice, DiarizeConfig(speakers=2)).count()
    frames = -(-len(one.first().samples) // 1536)
    out, _ = R.run_jobs(one, heard, voiced, spark.read.parquet(str(tmp_path / "known")), config=DiarizeConfig(speakers=2), min_similarity=0.8)
    names = {s["spk_id"] for r in out.collect() for s in json.loads(r.result)["segments"]}
    assert len(names) == 2 and (tmp_path / "speech").stat().st_size == frames
    pieces = (tmp_path / "voice").stat().st_size - windows
    assert 2 <= pieces <= 6  # the longest segments of two tags, once


def test_legacy_run_from_samples(spark):
    def talk(*parts):
        return np.concatenate([silence(p) if isinstance(p, float) else tone(p[0], p[1], k) for k, p in enumerate(parts)]).tolist()

    rows = [("two.wav", talk(1.0, ("ann", 12), 1.0, ("dora", 12), 1.0)), ("one.wav", talk(0.5, ("bob", 1), 0.5)), ("none.wav", talk(2.0))]
    df = spark.createDataFrame(rows, "path string, samples array<int>").withColumn("samples", F.col("samples").cast("array<smallint>"))
    loud = lambda b, rate: float(np.abs(np.frombuffer(b, "<i2").astype(float)).mean()) > 500
    found = R.legacy_turns(df, loud, speakers=2, window=100, least=30)
    name = {r.rec: r.path for r in R.with_rec(df).select("rec", "path").collect()}
    got = {}
    for r in found.orderBy("rec", "s").collect():
        got.setdefault(name[r.rec], []).append((round(r.s, 1), round(r.e, 1), r.label))
    assert set(got) == {"two.wav", "one.wav"} and len(got["one.wav"]) == 1 and got["one.wav"][0][0] == 0.0
    assert len({label for _, _, label in got["two.wav"]}) == 2
    (s1, e1, a), (s2, e2, b) = got["two.wav"][0], got["two.wav"][-1]
    assert a != b and abs(s1 - 1) < 0.2 and abs(e1 - 13) < 0.6 and abs(s2 - 14) < 0.6 and abs(e2 - 26) < 0.2
