"""From WAV files to identified speakers, with models that the caller gives.

A recording is known by ``path`` in the audio tables and by ``rec``, a hash of it, in the analytic ones.
Samples move once, from the reader to the pieces that are embedded; everything else is narrow.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocaris.operators import binary_keys, framing, identify, similarity, store, turns, vad
from vocaris.plans.pipelines import DIARIZE, DiarizeConfig, diarize, speech_windows
from vocaris.sources import audio
from vocaris.sources.shared import cut

Model = Callable[[np.ndarray], np.ndarray]


def with_rec(recordings: DataFrame) -> DataFrame:
    return recordings.withColumn("rec", F.xxhash64("path"))


def cut_pieces(recordings: DataFrame, pieces: DataFrame) -> DataFrame:
    """pieces (rec, ..., s, e; in samples) with samples, cut out of recordings (rec, samples). The pieces
    of one recording are gathered beside its samples, so that these are shuffled once."""
    rest = [c for c in pieces.columns if c != "rec"]
    grouped = pieces.groupBy("rec").agg(F.collect_list(F.struct(*rest)).alias("pieces"))
    each = recordings.select("rec", "samples").join(grouped, "rec").select("rec", "samples", F.explode("pieces").alias("p"))
    return each.select("rec", *[F.col(f"p.{c}").alias(c) for c in rest], F.expr("slice(samples, cast(p.s as int) + 1, cast(greatest(p.e - p.s, 0) as int))").alias("samples"))


def embedded_windows(recordings: DataFrame, speech: Model, voice: Model, config: DiarizeConfig = DIARIZE, frame: int = 1536) -> DataFrame:
    """(rec, k, s, e, embedding) of the speech windows of recordings (path, samples)."""
    known = with_rec(recordings)
    frames = audio.score_frames(recordings, speech, frame).select(F.xxhash64("path").alias("rec"), F.col("i").cast("long").alias("i"), "p")
    lengths = known.select("rec", F.size("samples").cast("long").alias("samples"))
    windows = speech_windows(frames, lengths, config)
    number = (F.row_number().over(Window.partitionBy("rec").orderBy("s", "e")) - 1).cast("int")
    return audio.embed(cut_pieces(known, windows.select("rec", number.alias("k"), "s", "e")), voice)


def diarize_audio(recordings: DataFrame, speech: Model, voice: Model, config: DiarizeConfig = DIARIZE, counts: DataFrame | None = None) -> DataFrame:
    """Turns (rec, seg, s, e, label), in seconds, of recordings (path, samples). One without speech has
    none. counts (rec, speakers, most) gives recordings numbers of speakers of their own."""
    # windows are read twice, by clustering and by turns: written, so that the models run once
    return diarize(cut(embedded_windows(recordings, speech, voice, config)), config, counts)


def legacy_turns(recordings: DataFrame, detector: Callable[[bytes, int], bool], speakers: int | None = None, hop: int = 30, shift: float = 0.01, least: int = 30, **settings: int) -> DataFrame:
    """Turns (rec, seg, s, e, label), in seconds, of recordings (path, samples) by the binary-key run:
    coefficients of every frame, the detector's speech as a mask over them, labels of the speech frames,
    and runs of labels. Where only one speaker comes out, or there is one segment of speech only, the
    whole recording is one turn; a recording without speech has none."""
    recs = with_rec(recordings)
    frames = cut(audio.features(recordings).select(F.xxhash64("path").alias("rec"), F.col("i").cast("long").alias("i"), "mfcc"))
    heard = audio.frame_speech(recordings, detector, hop=hop).select(F.xxhash64("path").alias("rec"), F.col("i").cast("long").alias("i"), "speech")
    voiced = vad.runs(heard, F.col("speech") == 1)
    # a run of frames is one of samples, [first, last] of them
    size = audio.RATE * hop // 1000
    seconds = vad.run_seconds(voiced.select("rec", "run", (F.col("first") * size).alias("first"), ((F.col("last") + 1) * size - 1).alias("last")), audio.RATE)
    mask = vad.mask_of_seconds(frames.select("rec", "i"), seconds, shift).where("speech = 1").select("rec", "i")
    labelled = cut(binary_keys.diarize(frames.join(mask, ["rec", "i"]).select("rec", F.col("i").cast("int").alias("i"), "mfcc"), speakers=speakers, **settings))
    names = labelled.groupBy("rec").agg(F.count_distinct("label").alias("names"))
    several = frames.select("rec", "i").join(names.where("names > 1"), "rec").join(labelled.withColumn("i", F.col("i").cast("long")), ["rec", "i"], "left").select("rec", "i", F.coalesce("label", F.lit(0)).alias("label"))
    found = turns.frame_labels_to_turns(several, least)
    many = found.select("rec", F.col("turn").alias("seg"), (F.col("first") * shift).alias("s"), ((F.col("first") + F.col("n")) * shift).alias("e"), F.col("label").cast("string").alias("label"))
    length = frames.groupBy("rec").agg(((F.max("i") + 1) * shift).alias("e"))
    alone = names.where("names = 1").join(length, "rec").select("rec", F.lit(1).alias("seg"), F.lit(0.0).alias("s"), "e", F.lit("1").alias("label"))
    return many.unionByName(alone).join(recs.select("rec").distinct(), "rec", "left_semi")


def results(found: DataFrame, digits: int = 2) -> DataFrame:
    """(rec, result): the wire document of each recording's turns."""
    return turns.json_result(found, digits)


def voiceprints(clips: DataFrame, voice: Model, model_id: str, rate: int = 16000, most: int = 180, least: int = 3) -> DataFrame:
    """(speaker, vector, model_id, dim, duration_used, files_used, error) of clips (speaker, pos, samples):
    a speaker's clips in order up to ``most`` seconds, joined and embedded as one; null samples are files
    that couldn't be read. With less than ``least`` seconds vector is null and error says why. The
    budget bounds what a speaker's group holds."""
    size = F.size("samples").cast("long")
    before = F.coalesce(F.sum(F.when(F.col("samples").isNotNull(), size)).over(Window.partitionBy("speaker").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = clips.withColumn("room", F.lit(rate * most) - before).select("speaker", "pos", F.when((F.col("room") > 0) & F.col("samples").isNotNull(), F.slice("samples", F.lit(1), F.greatest(F.lit(0), F.least(F.col("room"), size)).cast("int"))).alias("samples"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.asarray(x) for x in group.sort_values("pos").samples if x is not None and len(x)]
        n = sum(map(len, parts))
        error = "no_valid_audio" if not parts else "audio_too_short" if n < rate * least else None
        vector = None if error else np.asarray(voice(np.concatenate(parts).astype(np.float32) / 32768), dtype=np.float32).reshape(-1)
        return pd.DataFrame({"speaker": [group.speaker.iloc[0]], "vector": [vector], "model_id": [model_id], "dim": pd.array([None if vector is None else len(vector)], "Int32"), "duration_used": [round(n / rate, 3)], "files_used": [len(parts)], "error": [error]})

    return taken.groupBy("speaker").applyInPandas(one, "speaker string, vector array<float>, model_id string, dim int, duration_used double, files_used int, error string")


def tag_vectors(recordings: DataFrame, found: DataFrame, voice: Model, rate: int = 16000, most: int = 180) -> DataFrame:
    """(rec, spk, vector): for each tag of the turns, its longest segments up to ``most`` seconds together,
    each embedded, and the mean by length."""
    chosen = framing.select_longest(found.select("rec", F.col("label").alias("spk"), "seg", "s", "e"), rate, most)
    start = F.floor(F.col("s") * rate).cast("long")
    pieces = chosen.select("rec", "spk", "seg", start.alias("s"), (start + F.col("take")).alias("e"))
    each = audio.embed(cut_pieces(with_rec(recordings), pieces), voice)
    weighed = each.select("rec", "spk", F.posexplode("embedding").alias("d", "x"), (F.col("e") - F.col("s")).alias("w"))
    mean = weighed.groupBy("rec", "spk", "d").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    return mean.groupBy("rec", "spk").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda y: y.x).alias("vector"))


def identify_recordings(recordings: DataFrame, found: DataFrame, points: DataFrame, voice: Model, min_similarity: float = 0.5, k: int = 10, twice: bool = True) -> DataFrame:
    """(rec, spk, speaker_id, name, votes) of the tags of the turns whose voice is among points (point,
    vector, speaker_id, name). With twice = False no speaker is found twice in a recording."""
    vectors = cut(tag_vectors(recordings, found, voice).withColumn("query", F.xxhash64("rec", "spk")))  # the model runs once
    hits = similarity.top_k(vectors.select("query", "vector"), points, k).join(points.select("point", "speaker_id", "name"), "point")
    tagged = hits.join(vectors.select("query", "rec", "spk"), "query").withColumn("ord", F.col("rank"))
    if twice:
        won = identify.votes(tagged, min_similarity).where("speaker_id is not null")
        return won.join(vectors.select("query", "rec", "spk"), "query").select("rec", "spk", "speaker_id", "name", "votes")
    tags = identify.speech_order(found.select("rec", F.col("label").alias("spk"), "seg", "s", "e")).select("rec", "spk", "total", "first")
    return identify.identify_exclusive(tags, tagged.select("rec", "spk", "ord", "score", "speaker_id", "name"), min_similarity)


def run_jobs(recordings: DataFrame, speech: Model, voice: Model, points: DataFrame | None = None, cache: DataFrame | None = None, config: DiarizeConfig = DIARIZE, min_similarity: float = 0.5) -> tuple[DataFrame, DataFrame | None]:
    """(path, result) of recordings (path, content, samples), and the cache with what was new: results
    that the cache (key, result) has aren't computed again. Tags are named where points are given.
    recordings and cache are read again; pass written tables."""
    keyed = recordings.withColumn("key", store.cache_key(F.col("content"), F.lit(config.speakers).cast("int"), F.lit(None).cast("int")))
    todo = keyed if cache is None else store.uncached(keyed, cache)
    found = diarize_audio(todo, speech, voice, config)
    if points is not None:
        who = identify_recordings(todo, found, points, voice, min_similarity)
        named = identify.map_names(found.withColumnRenamed("label", "spk"), who)
        found = named.select("rec", "seg", "s", "e", F.col("who").alias("label"))
    done = todo.select("key", F.xxhash64("path").alias("rec")).join(results(found), "rec").select("key", "result").dropDuplicates(["key"])
    all_ = done if cache is None else store.put_results(cache, done)
    return keyed.select("path", "key").join(all_.select("key", "result"), "key", "left").select("path", "result"), all_
