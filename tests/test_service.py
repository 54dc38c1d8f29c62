import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_recordings import points, silence, speech, tone, voice

from vocaris.operators import clustering
from vocaris.plans import service
from vocaris.plans.service import Service
from vocaris.settings import Settings
from vocaris.sources import audio, results
from vocaris.streaming import jobs

ONE, TWO, OLD = ("spkid_" + "a" * 24 + "_" + c * 24 for c in "bcd")


def talk(*names, seed=0):
    parts = [silence(1)]
    for k, name in enumerate(names):
        parts += [tone(name, 6, seed + k), silence(1.5)]
    return np.concatenate(parts)


def stored(spark):
    """Ann and Bob in one collection, Ann under another id and Cid in another, Dora by another model."""
    known = {r.speaker: r.vector for r in points(spark).where("error is null").collect()}
    rows = [(c, str(k), i, n.title(), known[n], m) for k, (c, i, n, m) in enumerate([(ONE, "label:ann", "ann", "m1"), (ONE, "label:bob", "bob", "m1"), (TWO, "user:ann", "ann", "m1"), (TWO, "label:cid", "cid", "m1"), (OLD, "label:dora", "dora", "m0")])]
    return spark.createDataFrame(rows, "collection string, point_id string, speaker_id string, name string, vector array<float>, model_id string"), spark.createDataFrame([(ONE,), (TWO,), (OLD,)], "collection string")


def answers(spark, rows, **more):
    p, c = stored(spark)
    df = spark.createDataFrame(rows, "key string, content binary, speaker_count int, max_speaker int, collections array<string>, speakers array<string>, min_similarity double")
    return {r.key: json.loads(r.result) for r in Service(speech, voice, "m1", p, c, **more).answer(df).collect()}


def who(document):
    return [s["spk_id"] for s in document["segments"]]


def test_every_job_is_answered_as_it_asks(spark):
    two = audio.wav_bytes(talk("ann", "bob", "ann"))
    rows = [
        ("plain", two, 2, None, None, None, None), ("one", two, 1, None, None, None, None), ("most", two, None, 1, None, None, None),
        ("named", two, 2, None, [ONE], None, 0.8), ("again", two, 2, None, [ONE], None, 0.8), ("again", two, 2, None, [ONE], None, 0.8),
        ("only", two, 2, None, [ONE], ["label:bob"], 0.8), ("nobody", two, 2, None, [ONE], [], 0.8), ("strict", two, 2, None, [ONE], None, 1.0),
        ("other", two, 2, None, [TWO, OLD, TWO], None, 0.8), ("old", two, 2, None, [OLD, "gone"], None, 0.8),
        ("silent", audio.wav_bytes(silence(3)), 0, None, [ONE], None, 0.8), ("text", b"no wav", 2, None, None, None, None), ("null", None, 2, None, None, None, None),
    ]
    got = answers(spark, rows)
    assert set(got) == {r[0] for r in rows} - {"text", "null"}
    tags = ["spk1", "spk2", "spk1"]
    assert who(got["plain"]) == who(got["old"]) == who(got["nobody"]) == who(got["strict"]) == tags
    assert set(who(got["one"])) == set(who(got["most"])) == {"spk1"}
    assert who(got["named"]) == who(got["again"]) == ["Ann", "Bob", "Ann"] and who(got["only"]) == ["spk1", "Bob", "spk1"] and who(got["other"]) == ["Ann", "spk2", "Ann"]
    assert got["silent"] == {"speakers": [], "segments": []}
    speakers = got["named"]["speakers"]
    assert [list(s) for s in speakers] == [["spk_id", "spk_id_score", "duration", "nbr_seg"]] * 2 and [s["nbr_seg"] for s in speakers] == [2, 1]
    assert all(0.8 <= s["spk_id_score"] <= 1.001 for s in speakers)
    for s in speakers:
        assert s["duration"] == pytest.approx(sum(round(x["seg_end"] - x["seg_begin"], 3) for x in got["named"]["segments"] if x["spk_id"] == s["spk_id"]), abs=1e-6)
    assert [list(s) for s in got["nobody"]["speakers"]] == [["spk_id", "duration", "nbr_seg"]] * 2


def test_nobody_is_found_twice_if_so_set(spark):
    rows = [("k", audio.wav_bytes(talk("ann", "bob", "ann")), 2, None, [ONE], None, -1.0)]
    # at this similarity everybody is a candidate for every tag
    assert who(answers(spark, rows, settings=Settings(identify_twice=False))["k"]) == ["Ann", "Bob", "Ann"]


def test_no_jobs_and_no_store(spark):
    assert answers(spark, []) == {}
    df = spark.createDataFrame([("k", audio.wav_bytes(talk("ann", "bob")), 2, None, [ONE], None, 0.1)], "key string, content binary, speaker_count int, max_speaker int, collections array<string>, speakers array<string>, min_similarity double")
    assert who(json.loads(Service(speech, voice, "m1").answer(df).first().result)) == ["spk1", "spk2"]


def test_requests_from_files_to_documents(spark, tmp_path):
    (tmp_path / "audio").mkdir()
    (tmp_path / "in").mkdir()
    (tmp_path / "audio" / "a.wav").write_bytes(audio.wav_bytes(talk("ann", "bob")))
    (tmp_path / "audio" / "b.wav").write_text("no audio")
    spec = json.dumps({"collections": [ONE], "minSimilarity": 0.8})
    asked = [("r1", "a.wav", 2, None), ("r2", "a.wav", 2, spec), ("r3", "a.wav", 2, json.dumps({"collections": [ONE], "speakers": ["label:ann"]})), ("r4", "b.wav", 0, None), ("r5", "a.wav", 2, '{"collections": []}')]
    (tmp_path / "in" / "1.json").write_text("".join(json.dumps({"request_id": i, "path": p, "speaker_count": n, "max_speaker": 0, "speaker_names": s}) + "\n" for i, p, n, s in asked))
    p, c = stored(spark)
    stream = jobs.JobStream(str(tmp_path / "out"), jobs.binary_content(spark, str(tmp_path / "audio")), Service(speech, voice, "m1", p, c, Settings(min_similarity="0.7")).answer, ceiling=50)
    stream.start(stream.submit(spark, str(tmp_path / "in"))).awaitTermination()
    got = {r.request_id: r for r in stream.answers(spark).collect()}
    assert [got[k].status for k in ("r1", "r2", "r3", "r4", "r5")] == ["done", "done", "done", "failed", "rejected"]
    assert [who(json.loads(got[k].result)) for k in ("r1", "r2", "r3")] == [["spk1", "spk2"], ["Ann", "Bob"], ["Ann", "spk2"]]


def test_folder_as_rttm(spark, tmp_path):
    folder = tmp_path / "wavs"
    (folder / "sub dir").mkdir(parents=True)
    (folder / "a.wav").write_bytes(audio.wav_bytes(talk("ann", "bob")))
    (folder / "sub dir" / "a.b.wav").write_bytes(audio.wav_bytes(talk("cid", "dora", "cid", seed=9)))
    (folder / "silent.wav").write_bytes(audio.wav_bytes(silence(2)))
    (folder / "broken.wav").write_text("x")
    service.write_folder(spark, str(folder), str(tmp_path / "out"), speech, voice, service.DiarizeConfig(speakers=2))
    got = {}
    for r in results.read_rttm(spark, str(tmp_path / "out")).orderBy("rec", "s").collect():
        got.setdefault(r.rec, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {"a": 2, "sub_dir/a.b": 3}
    labels = [r.label for r in got["sub_dir/a.b"]]
    assert labels[0] == labels[2] != labels[1] and abs(got["a"][0].s - 1) < 0.3 and abs(got["a"][0].e - 7) < 0.3


def test_start(spark, tmp_path):
    folder = tmp_path / "samples"
    (folder / "Ann").mkdir(parents=True)
    for k in range(2):
        (folder / "Ann" / f"{k}.wav").write_bytes(audio.wav_bytes(tone("ann", 2, k)))
    (folder / "Bob.wav").write_bytes(audio.wav_bytes(tone("bob", 4)))
    (folder / "short.wav").write_bytes(audio.wav_bytes(tone("bob", 1)))
    p = spark.createDataFrame([("here", "9", "Old", [1.0], "m1")], "collection string, point_id string, name string, vector array<float>, model_id string")
    c = spark.createDataFrame([("here", 32, "COSINE")], "collection string, dim int, distance string")

    def done(samples=str(folder), again=False, **settings):
        p2, c2, what, report = service.start(spark, Settings(**settings), p, c, samples, voice, "m1", 32, again)
        return what, sorted((r.collection, r.point_id, r.name) for r in p2.collect()), sorted(r.collection for r in c2.collect()), report and {r.speaker: r.error for r in report.collect()}

    before = [("here", "9", "Old")]
    assert done() == ("off", before, ["here"], None)
    assert done(None, store="s") == ("no samples", before, ["here"], None)
    assert done(store="s") == ("no collection", before, ["here"], None)
    assert done(store="s", legacy_collection="here") == ("kept", before, ["here"], None)
    report = {"Ann": None, "Bob": None, "short": "audio_too_short"}
    assert done(store="s", legacy_collection="new") == ("enrolled", [*before, ("new", "1", "Ann"), ("new", "2", "Bob")], ["here", "new"], report)
    assert done(again=True, store="s", legacy_collection="here") == ("enrolled", [("here", "1", "Ann"), ("here", "2", "Bob")], ["here"], report)


def test_own_numbers_of_speakers(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(np.eye(4, 8), 10, axis=0) + rng.normal(size=(40, 8)) * 0.01
    rows = [(rec, k, v.tolist()) for rec in (1, 2, 3, 4) for k, v in enumerate(x)] + [(5, 0, x[0].tolist())]
    counts = spark.createDataFrame([(1, 2, None), (2, None, 3), (3, None, None), (5, 4, None)], "rec long, speakers int, most int")
    for method, want in (("auto_spectral", {1: 2, 2: 3, 3: 4, 4: 4, 5: 1}), ("agglomerative", {1: 2, 2: 4, 3: 4, 4: 4, 5: 1})):
        found = clustering.cluster(spark.createDataFrame(rows, "rec long, k int, embedding array<double>"), method, counts=counts)
        got = {r.rec: r.n for r in found.groupBy("rec").agg(F.count_distinct("label").alias("n")).collect()}
        assert {k: (v <= 3 if want[k] == 3 else v == want[k]) for k, v in got.items()} == dict.fromkeys(want, True), (method, got)
