"""WAV recordings as rows, decoded by the standard library in the executors."""

from __future__ import annotations

import io
import os
import uuid
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocaris.schemas import RECORDINGS
from vocaris.sources.resample import resample

RATE = 16000


def decode(content: bytes) -> tuple[int, int, np.ndarray] | None:
    """(rate, channels, samples as channels x n); None if the bytes aren't 16-bit PCM WAV."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            if w.getsampwidth() != 2:
                return None
            raw = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2")
            return w.getframerate(), w.getnchannels(), raw.reshape(-1, w.getnchannels()).T
    except (wave.Error, EOFError):
        return None


def to_mono_16k(rate: int, samples: np.ndarray) -> np.ndarray:
    """Mean of the channels, resampled without what a rate of 16 kHz can't hold."""
    mono = resample(samples.astype(np.float64).mean(axis=0), rate, RATE)
    return np.clip(np.round(mono), -32768, 32767).astype(np.int16)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, sr, channels, samples) of all WAV files under path, as 16 kHz mono; sr and channels are
    the file's own. Unreadable files come with nulls."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def decoded(files: DataFrame) -> DataFrame:
    """The same of files (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [None if c is None else decode(c) for c in part.content]
            yield pd.DataFrame(
                {"path": part.path, "sr": pd.array([r and r[0] for r in rows], "Int32"), "channels": pd.array([r and r[1] for r in rows], "Int32"), "samples": [None if r is None else to_mono_16k(r[0], r[2]) for r in rows]}
            )

    return files.select("path", "content").mapInPandas(run, RECORDINGS)


def is_16k_mono(df: DataFrame) -> DataFrame:
    return df.where((F.col("sr") == RATE) & (F.col("channels") == 1))


def speakers(files: DataFrame, root: str) -> DataFrame:
    """(speaker, pos, path): a folder under root is a speaker with its files in order; a file right
    under root is a speaker of its own."""
    inner = F.regexp_replace(F.substring_index("path", root.rstrip("/"), -1), "^/+", "")
    name = F.when(F.instr(inner, "/") > 0, F.substring_index(inner, "/", 1)).otherwise(F.regexp_replace(inner, r"\.[^.]*$", ""))
    listed = files.select(name.alias("speaker"), "path").groupBy("speaker").agg(F.sort_array(F.collect_list("path")).alias("p"))
    return listed.select("speaker", F.posexplode("p").alias("pos", "path"))


def mfcc(samples: np.ndarray, rate: int = RATE, size: float = 0.03, shift: float = 0.01, bands: int = 30, low: float = 20.0, high: float = 7600.0) -> np.ndarray:
    """Frames x bands cepstral coefficients: Hann frames, mel bands, log, DCT-II."""
    n, hop = int(size * rate), int(shift * rate)
    if len(samples) < n:
        return np.zeros((0, bands))
    fft = 1 << (n - 1).bit_length()
    at = np.arange(0, len(samples) - n + 1, hop)[:, None] + np.arange(n)
    power = np.abs(np.fft.rfft(samples[at].astype(np.float64) * np.hanning(n), fft)) ** 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(high), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(fft, 1 / rate)
    up, down = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    logs = np.log(power @ np.maximum(0, np.minimum(up, down)).T + 1e-10)
    k = np.arange(bands)
    return logs @ (np.cos(np.pi * (k[:, None] + 0.5) * k[None] / bands) * np.sqrt(2 / bands))


def features(recordings: DataFrame) -> DataFrame:
    """(path, i, mfcc) of recordings."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, samples in zip(part.path, part.samples):
                m = mfcc(np.asarray(samples if samples is not None else []))
                yield pd.DataFrame({"path": path, "i": np.arange(len(m), dtype=np.int32), "mfcc": list(m)})

    return recordings.select("path", "samples").mapInPandas(run, "path string, i int, mfcc array<double>")


def score_frames(recordings: DataFrame, model: Callable[[np.ndarray], float], size: int = 1536) -> DataFrame:
    """(path, i, p): the model's speech probability of every frame in order, the last one padded. A
    model with memory has ``reset()``, called before each recording."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, samples in zip(part.path, part.samples):
                getattr(model, "reset", lambda: None)()
                x = np.asarray(samples if samples is not None else [], dtype=np.float32) / 32768
                x = np.pad(x, (0, -len(x) % size)).reshape(-1, size)
                yield pd.DataFrame({"path": path, "i": np.arange(len(x), dtype=np.int32), "p": [float(model(f)) for f in x]})

    return recordings.select("path", "samples").mapInPandas(run, "path string, i int, p double")


def frame_speech(recordings: DataFrame, model: Callable[[bytes, int], bool], rate: int = RATE, hop: int = 30, mode: int = 0) -> DataFrame:
    """(path, i, speech): a frame-wise detector's answer for every frame of ``hop`` milliseconds, the last
    one padded. The model takes 16-bit bytes and the rate; one with modes has ``set_mode``."""
    if rate not in (8000, 16000, 32000, 48000):
        raise ValueError(f"rate {rate} is none of 8000, 16000, 32000 and 48000")
    if hop not in (10, 20, 30):
        raise ValueError(f"hop {hop} is none of 10, 20 and 30 ms")
    if mode not in (0, 1, 2, 3):
        raise ValueError(f"mode {mode} is none of 0 to 3")
    size = rate * hop // 1000

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        getattr(model, "set_mode", lambda _: None)(mode)
        for part in parts:
            for path, samples in zip(part.path, part.samples):
                x = np.asarray(samples if samples is not None else [], dtype="<i2")
                x = np.pad(x, (0, -len(x) % size)).reshape(-1, size)
                yield pd.DataFrame({"path": path, "i": np.arange(len(x), dtype=np.int32), "speech": [int(bool(model(f.tobytes(), rate))) for f in x]})

    return recordings.select("path", "samples").mapInPandas(run, "path string, i int, speech int")


def as_int16(samples: np.ndarray) -> np.ndarray:
    """16-bit samples of floats in [-1, 1] or of wider integers, which are scaled by their range."""
    x = np.asarray(samples)
    if x.dtype == np.int16:
        return x
    scale = 32767.0 if x.dtype.kind == "f" else 32767.0 / np.iinfo(x.dtype).max
    return np.clip(np.round(x.astype(np.float64) * scale), -32768, 32767).astype(np.int16)


def write_wavs(pieces: DataFrame, folder: str, rate: int = RATE) -> DataFrame:
    """Write pieces (name, samples) as ``<name>.wav`` under a folder that all executors share, and return
    (name, path). A file is complete before it has its name, so that a repeated task does no harm."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            paths = [os.path.join(folder, f"{name}.wav") for name in part.name]
            for path, samples in zip(paths, part.samples):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                own = f"{path}.{uuid.uuid4()}.part"
                with open(own, "wb") as out:
                    out.write(wav_bytes(as_int16(np.asarray(samples)), rate))
                os.replace(own, path)
            yield pd.DataFrame({"name": part.name, "path": paths})

    return pieces.select("name", "samples").mapInPandas(run, "name string, path string")


def embed(pieces: DataFrame, model: Callable[[np.ndarray], np.ndarray], least: int = 640) -> DataFrame:
    """pieces (..., samples) with embedding; short ones are padded with zeros."""
    schema = [*[f for f in pieces.schema.fields if f.name != "samples"]]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", embedding array<float>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            pad = [np.pad(np.asarray(s, dtype=np.float32) / 32768, (0, max(0, least - len(s)))) for s in part.samples]
            yield part.drop(columns="samples").assign(embedding=[np.asarray(model(p), dtype=np.float32) for p in pad])

    return pieces.mapInPandas(run, ddl)


def wav_bytes(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, dtype="<i2").tobytes())
    return out.getvalue()
