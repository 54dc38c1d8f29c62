"""Cutting recordings into frames, windows and budgeted pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames(lengths: DataFrame, size: int = 1536) -> DataFrame:
    """(rec, i, s, e) of consecutive frames of size samples; the last one is padded."""
    n = F.greatest(F.ceil(F.col("samples") / size), F.lit(1)) - 1
    return lengths.where("samples > 0").select("rec", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("i")).select("rec", "i", (F.col("i") * size).alias("s"), ((F.col("i") + 1) * size).alias("e"))


def sliding_windows(utterances: DataFrame, window: int = 24000, hop: int = 12000) -> DataFrame:
    """Windows (rec, utt, k, s, e) inside each utterance: one every hop while it fits before the last
    sample, then one up to the last sample. k numbers a recording's windows."""
    n = F.col("e") - F.col("s")
    full = F.when(n > window, F.floor((n - window - 1) / hop) + 1).otherwise(0).cast("long")
    starts = F.transform(F.sequence(F.lit(0).cast("long"), full), lambda j: j * hop)
    each = utterances.where("e > s").select("rec", "utt", "s", "e", full.alias("full"), F.posexplode(starts).alias("j", "at"))
    end = F.when(F.col("j") < F.col("full"), F.col("at") + window).otherwise(F.col("e") - F.col("s") - 1)
    placed = each.select("rec", "utt", "j", (F.col("s") + F.col("at")).alias("ws"), (F.col("s") + end).alias("we"))
    order = Window.partitionBy("rec").orderBy("utt", "j")
    return placed.select("rec", "utt", F.row_number().over(order).alias("k"), F.col("ws").alias("s"), F.col("we").alias("e"))


def segment_table(runs: DataFrame, length: int = 100, step: int = 100, context: int = 100) -> DataFrame:
    """Segments with context inside each speech run (rec, run, first, last): core [beg, end] and
    context [bbeg, eend] clipped to the run. A run of one frame has none."""
    starts = F.sequence(F.col("first").cast("long"), (F.col("last") - 1).cast("long"), F.lit(step).cast("long"))
    each = runs.where("last > first").select("rec", "run", "first", "last", F.explode(starts).alias("beg"))
    end = F.least(F.col("beg") + length - 1, F.col("last"))
    return each.select(
        "rec", "run", F.greatest(F.col("beg") - context, F.col("first")).cast("long").alias("bbeg"), "beg", end.cast("long").alias("end"), F.least(end + context, F.col("last")).cast("long").alias("eend")
    )


def within_budget(clips: DataFrame, keys: list[str], size: str, order: list[Column], budget: int) -> DataFrame:
    """clips with take: how many of its units fit into what the budget has left after the clips before
    it. Clips that get nothing go."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return clips.withColumn("take", F.greatest(F.lit(0), F.least(F.col(size), F.lit(budget) - before)).cast("long")).where("take > 0")


def select_longest(segments: DataFrame, rate: int = 16000, seconds: int = 180) -> DataFrame:
    """Of each speaker's segments (rec, spk, seg, s, e in seconds), the longest first until the budget
    is used; the last one is cut."""
    clips = segments.withColumn("n", (F.floor(F.col("e") * rate) - F.floor(F.col("s") * rate)).cast("long"))
    return within_budget(clips, ["rec", "spk"], "n", [(F.col("e") - F.col("s")).desc(), F.col("seg")], rate * seconds)
