"""Voice activity from frame scores: hysteresis, padding, masks and runs.

Frames have (rec, i, p). Every step is a window over one recording; the sequential state of the
hysteresis is two running sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VadConfig:
    """Samples throughout, at 16 kHz."""

    # fixed values
    threshold: float = 0.5
    negative_gap: float = 0.15
    min_speech: int = 4000
    min_silence: int = 1600
    frame: int = 1536
    pad: int = 480


VAD = VadConfig()


def hysteresis(frames: DataFrame, lengths: DataFrame | None = None, config: VadConfig = VAD) -> DataFrame:
    """Speech (rec, utt, s, e). Speech opens at p >= threshold and ends where p first fell below the
    lower threshold, once min_silence has passed since; it is kept if longer than min_speech, or if
    it is still open at the end. lengths (rec, samples) gives true lengths; else frames count.

    A group is a high frame and the frames up to the next high one; speech closes in a group that
    has low frames at least min_silence apart, and a closed group ends an island.
    """
    by_rec = Window.partitionBy("rec").orderBy("i")
    running = by_rec.rowsBetween(Window.unboundedPreceding, 0)
    high, low = F.col("p") >= config.threshold, F.col("p") < F.lit(config.threshold - config.negative_gap)
    numbered = frames.withColumn("grp", F.sum(F.when(high, 1).otherwise(0)).over(running))
    last = numbered.withColumn("last", F.max("i").over(Window.partitionBy("rec")))
    groups = (
        last.where("grp > 0")
        .groupBy("rec", "grp")
        .agg(F.min("i").alias("h"), F.min(F.when(low, F.col("i"))).alias("l1"), F.max(F.when(low, F.col("i"))).alias("l2"), F.max("last").alias("last"))
        .withColumn("closed", F.coalesce((F.col("l2") - F.col("l1")) * config.frame >= config.min_silence, F.lit(False)))
    )
    before = Window.partitionBy("rec").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    islands = groups.withColumn("isl", F.coalesce(F.sum(F.when(F.col("closed"), 1).otherwise(0)).over(before), F.lit(0)))
    found = islands.groupBy("rec", "isl").agg(
        F.min("h").alias("h"), F.max(F.when(F.col("closed"), F.col("l1"))).alias("l1"), F.max("last").alias("last")
    )
    if lengths is None:
        found = found.withColumn("samples", (F.col("last") + 1).cast("long") * config.frame)
    else:
        found = found.join(lengths, "rec")
    s, closed_at = F.col("h").cast("long") * config.frame, F.col("l1").cast("long") * config.frame
    kept = found.where(F.col("l1").isNull() | (closed_at - s > config.min_speech))
    return kept.select("rec", F.row_number().over(Window.partitionBy("rec").orderBy("isl")).alias("utt"), s.alias("s"), F.coalesce(closed_at, F.col("samples")).alias("e"))


def pad(speech: DataFrame, lengths: DataFrame, config: VadConfig = VAD) -> DataFrame:
    """Edges moved outwards: the first start, and every end; where two ends would meet, both take half
    of the silence. Later starts move only in that case. lengths: (rec, samples)."""
    w = Window.partitionBy("rec").orderBy("utt")
    nxt, prv = F.lead("s").over(w), F.lag("e").over(w)
    gap_after, gap_before = nxt - F.col("e"), F.col("s") - prv
    start = (
        F.when(prv.isNull(), F.greatest(F.lit(0), F.col("s") - config.pad))
        .when(gap_before < 2 * config.pad, F.greatest(F.lit(0), F.col("s") - F.floor(gap_before / 2)))
        .otherwise(F.col("s"))
    )
    end = (
        F.when(nxt.isNull(), F.least(F.col("samples"), F.col("e") + config.pad))
        .when(gap_after < 2 * config.pad, F.col("e") + F.floor(gap_after / 2))
        .otherwise(F.col("e") + config.pad)
    )
    return speech.join(lengths, "rec").select("rec", "utt", start.cast("long").alias("s"), end.cast("long").alias("e"))


def runs(frames: DataFrame, flag: Column) -> DataFrame:
    """Runs of frames where flag holds: (rec, run, first, last)."""
    w = Window.partitionBy("rec").orderBy("i")
    marked = frames.where(flag).select("rec", "i", (F.col("i") - F.row_number().over(w)).alias("island"))
    found = marked.groupBy("rec", "island").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    return found.select("rec", F.row_number().over(Window.partitionBy("rec").orderBy("first")).alias("run"), "first", "last")


def speech_index(frames: DataFrame, flag: Column) -> DataFrame:
    """Frames with pos, the 1-based number of each speech frame; 0 elsewhere."""
    w = Window.partitionBy("rec").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    on = F.when(flag, 1).otherwise(0)
    return frames.select("rec", "i", on.alias("speech"), F.when(flag, F.sum(on).over(w)).otherwise(0).cast("long").alias("pos"))


def frame_mask(frames: DataFrame, segments: DataFrame, bin_frames: int = 100) -> DataFrame:
    """Frames with speech = 1 inside any segment (rec, first, last), first <= i < last. A range join
    through bins, so that it is an equality join."""
    bins = segments.where("last > first").select("rec", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / bin_frames), F.floor((F.col("last") - 1) / bin_frames))).alias("bin"))
    keyed = frames.select("rec", "i", F.floor(F.col("i") / bin_frames).alias("bin"))
    hit = keyed.join(bins, ["rec", "bin"]).where("i >= first and i < last").select("rec", "i").distinct().withColumn("speech", F.lit(1))
    return frames.select("rec", "i").join(hit, ["rec", "i"], "left").select("rec", "i", F.coalesce("speech", F.lit(0)).alias("speech"))


def mask_of_seconds(frames: DataFrame, segments: DataFrame, shift: float = 0.01) -> DataFrame:
    """Frames (rec, i) of ``shift`` seconds with speech = 1 from the frame nearest to a segment's start
    (rec, s, e; in seconds) up to the one nearest to its end."""
    place = lambda name: F.bround(F.col(name) / shift).cast("long")
    return frame_mask(frames, segments.select("rec", place("s").alias("first"), place("e").alias("last")))


def smooth(series: DataFrame, value: str, width: int) -> DataFrame:
    """Moving average over an odd width that shrinks on both sides alike near the edges."""
    w = Window.partitionBy("rec").orderBy("i")
    all_ = Window.partitionBy("rec")
    numbered = series.select("rec", "i", value, F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(all_).alias("n"))
    half = F.least(F.lit(width // 2), F.col("rn") - 1, F.col("n") - F.col("rn")).cast("int")
    around = F.collect_list(value).over(w.rowsBetween(-(width // 2), width // 2))
    # the window has min(h, rn - 1) values before the row
    before = F.least(F.lit(width // 2), F.col("rn") - 1).cast("int")
    part = F.slice(around, before - half + 1, 2 * half + 1)
    return numbered.select("rec", "i", (F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / (2 * half + 1)).alias(value))


def run_seconds(runs_: DataFrame, rate: float) -> DataFrame:
    """Runs (rec, run, first, last) of voiced samples as seconds [first / rate, (last + 1) / rate); a
    single voiced sample is no speech."""
    kept = runs_.where("last > first")
    return kept.select("rec", "run", (F.col("first") / rate).alias("s"), ((F.col("last") + 1) / rate).alias("e"))


def in_seconds(speech: DataFrame, rate: int = 16000, digits: int = 1) -> DataFrame:
    return speech.withColumns({c: F.round(F.col(c) / rate, digits) for c in ("s", "e")})


def plot_data(series: DataFrame, value: str, width: int) -> DataFrame:
    """(rec, bucket, low, high) of each width frames: what a plot of the series needs."""
    bucket = F.floor(F.col("i") / width).alias("bucket")
    return series.groupBy("rec", bucket).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def probability_plot(frames: DataFrame, seconds: float, width: int) -> DataFrame:
    """(rec, t, low, high) of each width frames: the range of speech probabilities from second t on."""
    return plot_data(frames, "p", width).select("rec", (F.col("bucket") * width * F.lit(seconds)).alias("t"), "low", "high")
