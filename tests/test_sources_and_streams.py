import time

import numpy as np
from pyspark.sql import functions as F

from vocaris.operators import vad
from vocaris.sources import audio, results
from vocaris.streaming import speech


def test_wav_files_become_recordings(spark, tmp_path):
    t = np.arange(16000)
    tone = (8000 * np.sin(2 * np.pi * 440 * t / 16000)).astype(np.int16)
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann" / "1.wav").write_bytes(audio.wav_bytes(tone))
    (tmp_path / "ann" / "2.wav").write_bytes(audio.wav_bytes(tone[::2], 8000))
    (tmp_path / "bob.wav").write_bytes(b"not a wav")
    df = audio.read(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in df.collect()}
    assert rows["1.wav"].samples == tone.tolist() and rows["2.wav"].sr == 8000 and len(rows["2.wav"].samples) == 16000
    assert rows["bob.wav"].samples is None and audio.is_16k_mono(df).count() == 1
    listed = sorted((r.speaker, r.pos) for r in audio.speakers(df, str(tmp_path)).collect())
    assert listed == [("ann", 0), ("ann", 1), ("bob", 0)]
    features = audio.features(df.where("samples is not null"))
    assert features.groupBy("path").count().first()["count"] == 98 and features.first().mfcc[0] is not None

    class Loud:
        def __call__(self, frame):
            return float(np.abs(frame).mean() > 0.05)

    frames = audio.score_frames(df.where("sr = 16000"), Loud()).withColumn("rec", F.lit(1))
    assert [(r.s, r.e) for r in vad.hysteresis(frames).collect()] == [(0, 11 * 1536)]
    pieces = spark.createDataFrame([("a", tone[:100].tolist())], "id string, samples array<int>")
    assert len(audio.embed(pieces, lambda x: x[:192]).first().embedding) == 192


def test_rttm_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([("r", 0.5, 1.25, "spk1"), ("r", 1.25, 3.0, "spk2")], "rec string, s double, e double, label string")
    results.write_rttm(turns, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in results.read_rttm(spark, str(tmp_path / "out")).collect()) == sorted(tuple(r) for r in turns.collect())


def _stream_in_files(spark, df, conditions, path):
    for condition in conditions:
        df.where(condition).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are taken by age
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _scored(spark, rows):
    stamp = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("i") * 96)
    clock = spark.createDataFrame([(None, 10**6, 0.0)], "rec long, i long, p double")
    return spark.createDataFrame(rows, "rec long, i long, p double"), spark.createDataFrame(rows, "rec long, i long, p double").unionByName(clock).withColumn("ts", stamp)


def test_online_vad_equals_the_batch_and_forgets(spark, tmp_path):
    rnd = np.random.default_rng(3)
    rows = [(r, i, float(p)) for r in range(6) for i, p in enumerate(rnd.random(20 + 13 * r))]
    rows += [(6, i, 0.9) for i in range(30)] + [(7, 0, 0.9), (8, 0, 0.1)]  # open from the first frame to the last
    batch, df = _scored(spark, rows)
    # frames of one recording change places within the watermark's delay
    stream = _stream_in_files(spark, df, ["i % 50 < 25 and i < 60", "i % 50 >= 25 and i < 60", "i >= 60 and rec is not null", "rec is null"], str(tmp_path / "in"))
    with speech.keyed_state(spark):
        q = speech.online_vad(stream, late="20 seconds", idle="5 seconds").writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    state = q.lastProgress["stateOperators"][0]
    assert speech.late_rows(q) == 0 and state["numRowsTotal"] == 0
    q.stop()
    got = sorted((r.rec, r.s, r.e) for r in spark.sql("select * from online").collect())
    assert got == sorted((r.rec, r.s, r.e) for r in vad.hysteresis(batch).collect()) and {6, 7} <= {r for r, _, _ in got}


def test_online_vad_counts_late_frames(spark, tmp_path):
    batch, df = _scored(spark, [(1, i, 0.9) for i in range(100) if i != 3] + [(2, 500, 0.1), (1, 3, 0.9)])
    stream = _stream_in_files(spark, df, ["rec = 1 and i <> 3", "rec = 2", "rec = 1 and i = 3", "rec is null"], str(tmp_path / "in"))
    counted = speech.LateRows()
    spark.streams.addListener(counted)
    with speech.keyed_state(spark):
        q = speech.online_vad(stream, late="1 second", idle="5 seconds").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    assert speech.late_rows(q) == 1
    q.stop()
    time.sleep(1)
    spark.streams.removeListener(counted)
    assert counted.counts[str(q.id)] == 1
    assert [(r.rec, r.s, r.e) for r in spark.sql("select * from late").collect()] == [(1, 0, 100 * 1536)]


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    rows = [(1, "a", f"2024-01-01 00:00:0{s}") for s in (0, 2, 8)] + [(1, "a", "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "rec long, label string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = speech.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select * from sessions").collect()) == [1, 2]
