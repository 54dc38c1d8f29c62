import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocaris.sources import audio, models, resample


def test_a_worker_loads_a_model_once(spark, tmp_path):
    (tmp_path / "weights.txt").write_text("2.5")
    (tmp_path / "log").mkdir()
    spec = models.ModelSpec("scaled", "loaders:scaled", files=(str(tmp_path / "weights.txt"),), options=(("log", str(tmp_path / "log")),)).shipped(spark)
    assert spec.files == ("weights.txt",) and len(spec.revision) == 64
    rows = spark.range(64).select("id", F.when(F.col("id") != 5, F.array(F.col("id").cast("float"))).alias("x")).repartition(16)
    for _ in range(2):  # tasks of a second job find the model there
        got = {r.id: r.y for r in models.apply(rows, spec, "x", "y").collect()}
        assert got[4] == [10.0] and got[5] is None and len(got) == 64
    pids = [p.split("-")[0] for p in os.listdir(tmp_path / "log")]
    assert len(pids) == len(set(pids)) <= 16  # workers, not tasks: 32 tasks ran
    pieces = spark.createDataFrame([(k, [100 * k] * 700) for k in range(6)], "id long, samples array<int>").repartition(6)
    found = {r.id: r.embedding[0] for r in audio.embed(pieces, models.Held(spec)).collect()}
    assert all(v == pytest.approx(2.5 * 100 * k / 32768) for k, v in found.items())
    pids = [p.split("-")[0] for p in os.listdir(tmp_path / "log")]
    assert len(pids) == len(set(pids))


def test_revisions_are_pinned(spark, tmp_path):
    path = tmp_path / "other.txt"
    path.write_text("3")
    spec = models.ModelSpec("other", "loaders:scaled", files=(str(path),))
    right = models.digest(spec.files)
    assert models.ModelSpec("other", "loaders:scaled", right, (str(path),)).shipped(spark).revision == right
    with pytest.raises(ValueError, match="revision"):
        models.ModelSpec("other", "loaders:scaled", "0" * 64, (str(path),)).shipped(spark)
    wrong = models.ModelSpec("other", "loaders:scaled", "1" * 64, ("other.txt",))  # as if an executor had another file
    with pytest.raises(Exception, match="has other files"):
        models.apply(spark.range(1).select(F.array(F.lit(1.0)).alias("x")), wrong, "x", "y").collect()


def level(x, rate, hz):
    """Amplitude in decibels of full scale at a frequency, away from the edges."""
    x = x[len(x) // 4 : 3 * len(x) // 4] * np.hanning(len(x[len(x) // 4 : 3 * len(x) // 4])) * 2
    t = np.arange(len(x)) / rate
    return 20 * np.log10(2 * abs(np.mean(x * np.exp(-2j * np.pi * hz * t))) + 1e-12)


@pytest.mark.parametrize("rate", [8000, 11025, 22050, 32000, 44100, 48000])
def test_tones_stay_or_go(rate):
    t = np.arange(rate) / rate
    for hz in (200, 1000, 3000, 6500):
        if hz < 0.45 * rate:
            y = resample.resample(np.sin(2 * np.pi * hz * t), rate, 16000)
            assert len(y) == 16000 and abs(level(y, 16000, hz)) < 0.1
    if rate > 20000:
        y = resample.resample(np.sin(2 * np.pi * 10_000 * t), rate, 16000)
        spectrum = np.abs(np.fft.rfft(y[2000:14000] * np.hanning(12000))) * 4 / 12000
        assert 20 * np.log10(spectrum.max()) < -60


def test_edges_of_resampling():
    x = np.arange(10.0)
    assert np.array_equal(resample.resample(x, 16000, 16000), x) and len(resample.resample(np.zeros(0), 8000, 16000)) == 0
    flat = resample.resample(np.ones(4000), 48000, 16000)
    assert np.allclose(flat[200:-200], 1)
    with pytest.raises(ValueError):
        resample.resample(x, 0, 16000)
    stereo = np.stack([np.sin(np.arange(48000) * 0.05), -np.sin(np.arange(48000) * 0.05)]) * 1000
    assert not audio.to_mono_16k(48000, stereo).any()
    long = resample.resample(np.random.default_rng(0).normal(size=30_000), 44100, 16000)
    parts = resample.resample(np.random.default_rng(0).normal(size=30_000), 44100, 16000, block=100)
    assert np.allclose(long, parts)
