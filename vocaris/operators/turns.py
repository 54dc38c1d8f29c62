"""Speaker turns: resolving overlaps, merging, and the wire format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _islands(df: DataFrame, keys: list[str], order: list, starts: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("isl", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def resolve_overlaps(windows: DataFrame) -> DataFrame:
    """Labelled windows (rec, k, s, e, label) as turns: windows that touch or overlap and agree in
    label become one; where labels differ, both are cut in the middle of the overlap. An island ends
    with its last member, or where the next one was cut to begin."""
    w = Window.partitionBy("rec").orderBy("k")
    prev_e, prev_l = F.lag("e").over(w), F.lag("label").over(w)
    meets = F.coalesce(F.col("s") <= prev_e, F.lit(False))
    new = ~meets | (F.col("label") != prev_l)
    cut_start = F.when(meets & (F.col("label") != prev_l), F.col("s") + F.floor((prev_e - F.col("s")) / 2)).cast("long")
    marked = windows.withColumn("new", new).withColumn("cut", cut_start)
    islands = _islands(marked, ["rec"], ["k"], F.col("new"))
    turns = islands.groupBy("rec", "isl").agg(
        F.min_by("s", "k").alias("first"), F.max_by("e", "k").alias("last"), F.min("label").alias("label"), F.min_by("cut", "k").alias("cut")
    )
    by = Window.partitionBy("rec").orderBy("isl")
    return turns.select("rec", F.col("isl").cast("int").alias("turn"), F.coalesce("cut", "first").alias("s"), F.coalesce(F.lead("cut").over(by), F.col("last")).alias("e"), "label")


def merge_same_speaker(turns: DataFrame, tolerance: Column | float, order: str = "turn") -> DataFrame:
    """Neighbouring turns of one label with a gap of at most tolerance become one, which ends with its
    last member."""
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    w = Window.partitionBy("rec").orderBy(order)
    new = F.coalesce((F.lag("label").over(w) != F.col("label")) | (F.lag("e").over(w) + tolerance < F.col("s")), F.lit(True))
    islands = _islands(turns.withColumn("new", new), ["rec"], [order], F.col("new"))
    merged = islands.groupBy("rec", "isl").agg(F.min_by("s", order).alias("s"), F.max_by("e", order).alias("e"), F.min("label").alias("label"))
    return merged.select("rec", F.col("isl").cast("int").alias("turn"), "s", "e", "label")


def collar_merge(segments: DataFrame, collar: Column | float) -> DataFrame:
    """Per label, intervals closer than collar become one (their hull), whatever others say between."""
    collar = collar if isinstance(collar, Column) else F.lit(collar)
    before = Window.partitionBy("rec", "label").orderBy("s", "e", "seg").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.max("e").over(before) + collar < F.col("s"), F.lit(True))
    islands = _islands(segments.withColumn("new", new), ["rec", "label"], ["s", "e", "seg"], F.col("new"))
    return islands.groupBy("rec", "label", "isl").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("rec", "label", F.col("isl").cast("int").alias("part"), "s", "e")


def renumber(segments: DataFrame, order: str = "seg") -> DataFrame:
    """Segments with spk_id: spk1, spk2, ... by first appearance in the recording. Two windows, both
    served by one partitioning by recording."""
    first = segments.withColumn("__first", F.min(order).over(Window.partitionBy("rec", "label")))
    number = F.dense_rank().over(Window.partitionBy("rec").orderBy("__first"))
    return first.withColumn("spk_id", F.concat(F.lit("spk"), number.cast("string"))).drop("__first")


def wire_segments(segments: DataFrame, digits: int, order: str = "seg") -> DataFrame:
    """(rec, seg_id, spk_id, seg_begin, seg_end) in the wire format."""
    seg = F.row_number().over(Window.partitionBy("rec").orderBy(order))
    return renumber(segments, order).select("rec", seg.alias("seg_id"), "spk_id", F.round("s", digits).alias("seg_begin"), F.round("e", digits).alias("seg_end"))


def speaker_stats(segments: DataFrame, mode: str = "windowed", order: str = "seg") -> DataFrame:
    """(rec, spk_id, duration, nbr_seg). Modes differ in rounding: windowed rounds the sum to 2
    digits, neural sums parts rounded to 3, legacy rounds after every step to 2."""
    named = renumber(segments, order).withColumn("d", F.col("e") - F.col("s"))
    if mode == "windowed":
        duration = F.round(F.sum("d"), 2)
    elif mode == "neural":
        duration = F.round(F.sum(F.round("d", 3)), 3)
    elif mode == "legacy":
        parts = F.transform(F.sort_array(F.collect_list(F.struct(order, "d"))), lambda x: x.d)
        duration = F.aggregate(parts, F.lit(0.0), lambda s, x: F.round(s + F.round(x, 2), 2))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return named.groupBy("rec", "spk_id").agg(duration.alias("duration"), F.count(F.lit(1)).alias("nbr_seg"))


def of_legacy(rows: DataFrame) -> DataFrame:
    """Segments (rec, seg, s, e, label) of rows (rec, seg, start, duration, label) less the sentinel row
    of label -1 that closes a recording."""
    return rows.where("label <> -1").select("rec", "seg", F.col("start").alias("s"), (F.col("start") + F.col("duration")).alias("e"), F.col("label").cast("string").alias("label"))


def json_result(segments: DataFrame, digits: int = 2, mode: str = "windowed") -> DataFrame:
    """One JSON document per recording: {"speakers": [...], "segments": [...]}."""
    segs = wire_segments(segments, digits).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("seg_id", "spk_id", "seg_begin", "seg_end"))).alias("segments"))
    spks = speaker_stats(segments, mode).withColumn("n", F.substring("spk_id", 4, 10).cast("int"))
    spks = spks.groupBy("rec").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "spk_id", "duration", "nbr_seg"))), lambda x: F.struct(x.spk_id.alias("spk_id"), x.duration.alias("duration"), x.nbr_seg.alias("nbr_seg"))).alias("speakers"))
    return spks.join(segs, "rec").select("rec", F.to_json(F.struct("speakers", "segments")).alias("result"))


def frame_labels_to_turns(frames: DataFrame, min_frames: int = 30) -> DataFrame:
    """Frame labels (rec, i, label; 0 is silence) as turns (rec, turn, first, n, label): runs of at
    most min_frames count as silence, and silence between two runs of one speaker is absorbed."""
    w = Window.partitionBy("rec").orderBy("i")
    runs = _islands(frames.withColumn("new", F.coalesce(F.lag("label").over(w) != F.col("label"), F.lit(True))), ["rec"], ["i"], F.col("new"))
    runs = runs.groupBy("rec", "isl").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min("label").alias("label"))
    spoken = runs.where((F.col("label") != 0) & (F.col("last") - F.col("first") + 1 > min_frames)).withColumnRenamed("isl", "run")
    by = Window.partitionBy("rec").orderBy("run")
    joined = _islands(spoken.withColumn("new", F.coalesce(F.lag("label").over(by) != F.col("label"), F.lit(True))), ["rec"], ["run"], F.col("new"))
    out = joined.groupBy("rec", "isl").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("label").alias("label"))
    return out.select("rec", F.col("isl").cast("int").alias("turn"), "first", (F.col("last") - F.col("first") + 1).alias("n"), "label")


def transcript(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Words (rec, w, e, text) given to segments (rec, seg, e): segment number n takes the words from
    where n - 1 stopped up to the last word that ends before its own end, less one; the last segment
    takes the rest."""
    n = F.row_number().over(Window.partitionBy("rec").orderBy("w")) - 1
    return transcript_of_runs(segments, words.select("rec", n.cast("long").alias("n"), F.array("e").alias("ends"), F.array("text").alias("texts")))


def transcript_of_runs(segments: DataFrame, runs: DataFrame, block: int = 256) -> DataFrame:
    """As transcript, of runs (rec, n, ends, texts) of consecutive words, n words after the first of the
    recording; ends ascend in a run, and one run ends before the next in time begins. Runs are cut at
    blocks of words: no row holds more than a block, none is made for a word alone. Ends and marks are
    merged in order of time by one window; segments meet their words by block."""
    at = runs.withColumn("size", F.size("texts")).where("size > 0")
    blocks = F.sequence(F.floor(F.col("n") / block), F.floor((F.col("n") + F.col("size") - 1) / block))

    def cut(b: Column) -> Column:
        first = F.greatest(b * block, F.col("n"))
        size = (F.least((b + 1) * block, F.col("n") + F.col("size")) - first).cast("int")
        skip = (first - F.col("n") + 1).cast("int")
        return F.struct(b.alias("b"), first.alias("n"), size.alias("size"), F.slice("ends", skip, size).alias("ends"), F.slice("texts", skip, size).alias("texts"))

    pieces = at.select("rec", F.explode(F.transform(blocks, cut)).alias("x")).select("rec", "x.*")
    ends = pieces.select("rec", F.col("ends")[0].alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("seg"), F.col("size").cast("long").alias("size"), "ends")
    marks = segments.select("rec", F.col("e").alias("t"), F.lit(0).alias("kind"), "seg", F.lit(0).cast("long").alias("size"), F.lit(None).cast("array<double>").alias("ends"))
    w = Window.partitionBy("rec").orderBy("t", "kind", "seg").rowsBetween(Window.unboundedPreceding, 0)
    merged = ends.unionByName(marks).select("rec", "seg", "t", "kind", F.sum("size").over(w).alias("c"), F.last("ends", ignorenulls=True).over(w).alias("open"), F.sum("size").over(Window.partitionBy("rec")).alias("total"))
    late = F.coalesce(F.array_size(F.filter("open", lambda x: x >= F.col("t"))), F.lit(0))
    cuts = merged.where("kind = 0").select("rec", "seg", "total", F.greatest(F.col("c") - late - 1, F.lit(0)).alias("cut"))
    by = Window.partitionBy("rec").orderBy("seg")
    slices = cuts.select("rec", "seg", F.coalesce(F.lag("cut").over(by), F.lit(0)).alias("lo"), F.when(F.lead("seg").over(by).isNull(), F.col("total")).otherwise(F.col("cut")).alias("hi"))
    covered = F.when(F.col("lo") < F.col("hi"), F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block)))
    asked = slices.select("rec", "seg", "lo", "hi", F.explode_outer(covered).alias("b"))
    heard = pieces.select(F.col("rec").alias("of"), F.col("b").alias("at"), "n", "size", "texts")
    met = asked.join(heard, F.expr("of = rec and at = b and n < hi and n + size > lo"), "left")
    first = F.greatest("lo", "n")
    said = F.slice("texts", (first - F.col("n") + 1).cast("int"), (F.least("hi", F.col("n") + F.col("size")) - first).cast("int"))
    parts = met.select("rec", "seg", first.alias("n"), said.alias("said"))
    x = F.when(F.exists("said", lambda y: y.isNotNull()), F.struct("n", F.array_join("said", " ").alias("text")))
    return parts.groupBy("rec", "seg").agg(F.array_join(F.transform(F.sort_array(F.collect_list(x)), lambda y: y.text), " ").alias("text"))
