"""From scores and embeddings to identified speakers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocaris.operators import clustering, framing, identify, similarity, turns, vad


@dataclass(frozen=True)
class DiarizeConfig:
    # fixed values
    rate: int = 16000
    window: float = 1.5
    hop: float = 0.75
    tolerance: float = 3.0
    method: str = "auto_spectral"
    speakers: int | None = None
    vad: vad.VadConfig = vad.VAD


DIARIZE = DiarizeConfig()


def speech_windows(frames: DataFrame, lengths: DataFrame, config: DiarizeConfig = DIARIZE) -> DataFrame:
    """Padded speech of scored frames, cut into embedding windows (rec, utt, k, s, e)."""
    speech = vad.pad(vad.hysteresis(frames, lengths, config.vad), lengths, config.vad)
    return framing.sliding_windows(speech, int(config.window * config.rate), int(config.hop * config.rate))


def label_turns(windows: DataFrame, labels: DataFrame, config: DiarizeConfig = DIARIZE) -> DataFrame:
    """Turns (rec, seg, s, e, label) in seconds from windows and their cluster labels."""
    joined = windows.join(labels, ["rec", "k"]).select("rec", "k", "s", "e", F.col("label").cast("string").alias("label"))
    merged = turns.merge_same_speaker(turns.resolve_overlaps(joined), int(config.tolerance * config.rate))
    return merged.select("rec", F.col("turn").alias("seg"), (F.col("s") / float(config.rate)).alias("s"), (F.col("e") / float(config.rate)).alias("e"), "label")


def diarize(windows: DataFrame, config: DiarizeConfig = DIARIZE, counts: DataFrame | None = None) -> DataFrame:
    """Turns of embedded windows (rec, k, s, e, embedding). counts: see clustering.cluster."""
    return label_turns(windows.select("rec", "k", "s", "e"), clustering.cluster(windows, config.method, config.speakers, counts), config)


def identify_speakers(queries: DataFrame, voiceprints: DataFrame, min_similarity: float = 0.5, k: int = 10, allowed: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Winner of each query (query, vector) among voiceprints (point, vector, speaker_id, name)."""
    hits = similarity.top_k(queries, voiceprints, k).join(voiceprints.select("point", "speaker_id", "name"), "point")
    return identify.votes(hits.withColumn("ord", F.col("rank")), min_similarity, allowed, excluded, queries)
