"""Speakers that may overlap: local speakers of overlapping chunks, stitched over a recording.

A segmentation model sees a chunk at a time and gives, for each of its frames, how active each of a few
local speakers is; their order means nothing from chunk to chunk. Chunks of neighbouring numbers share
frames, on which their local speakers are compared: an assignment (Hungarian) links those that agree best.
Linked local speakers are one track (connected components over all recordings at once). Tracks that a
silence separates are joined by the voice, if embeddings are given. Activities of a speaker are then added
up with weights that fade towards a chunk's edges, and turns are the runs over a threshold: of different
speakers they may overlap.

Local activities are rows (rec, chunk, start, act): start is the chunk's first frame, act an array of
frames, each an array of local speakers' activities in [0, 1].
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocaris.operators import clustering, graphs, turns, vad
from vocaris.sources.shared import cut


@dataclass(frozen=True)
class StitchConfig:
    rate: int = 16000
    chunk: float = 10.0  # seconds
    step: float = 1.0
    frame: int = 160  # samples
    agreement: float = 0.5  # of two local speakers' activity, for a link
    onset: float = 0.5
    voice_distance: float = 0.5  # of tracks that are one speaker
    collar: float = 0.0  # seconds of silence inside a turn


STITCH = StitchConfig()

Segmenter = Callable[[np.ndarray], np.ndarray]


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row of the cheapest one-to-one assignment (Hungarian method); -1 for rows beyond the
    number of columns. Potentials of rows and columns keep all reduced costs at 0 or more; each row is
    added by the cheapest augmenting path."""
    rows, columns = cost.shape
    if rows > columns:
        other = assignment(cost.T)
        out = np.full(rows, -1)
        out[other] = np.arange(columns)
        return out
    row_of = np.full(columns, -1)
    by_row, by_column = np.zeros(rows), np.zeros(columns)
    for new in range(rows):
        # Dijkstra over columns from the new row
        length = cost[new] - by_row[new] - by_column
        came, done = np.full(columns, -1), np.zeros(columns, bool)
        while True:
            at = int(np.where(done, np.inf, length).argmin())
            done[at] = True
            if row_of[at] < 0:
                break
            r = row_of[at]
            through = length[at] + cost[r] - by_row[r] - by_column
            better = ~done & (through < length)
            length[better], came[better] = through[better], at
        end, total = at, length[at]
        inside = np.flatnonzero(done)
        for c in inside:
            if c != end:
                by_row[row_of[c]] += total - length[c]
            by_column[c] -= total - length[c]
        by_row[new] += total
        while came[at] >= 0:
            row_of[at] = row_of[came[at]]
            at = came[at]
        row_of[at] = new
    out = np.full(rows, -1)
    used = row_of >= 0
    out[row_of[used]] = np.flatnonzero(used)
    return out


def local_activity(recordings: DataFrame, segmenter: Segmenter, config: StitchConfig = STITCH) -> DataFrame:
    """(rec, chunk, start, act) of recordings (rec, samples). The segmenter answers samples in [-1, 1] of a
    chunk with frames x local speakers; the last chunk is padded with silence."""
    size, hop = int(config.chunk * config.rate) // config.frame * config.frame, int(config.step * config.rate) // config.frame * config.frame
    count = F.greatest(F.ceil((F.size("samples") - size) / hop), F.lit(0)).cast("long")
    each = recordings.where("size(samples) > 0").select("rec", "samples", F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("chunk"))
    cut_ = each.select("rec", F.col("chunk").cast("int").alias("chunk"), F.slice("samples", (F.col("chunk") * hop + 1).cast("int"), F.lit(size)).alias("samples"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            acts = []
            for x in part.samples:
                x = np.asarray(x, dtype=np.float32) / 32768
                acts.append([list(map(float, f)) for f in np.asarray(segmenter(np.pad(x, (0, size - len(x)))))])
            yield pd.DataFrame({"rec": part.rec, "chunk": part.chunk, "start": part.chunk.astype("int64") * (hop // config.frame), "act": acts})

    rec = recordings.schema["rec"].dataType.simpleString()
    return cut_.mapInPandas(run, f"rec {rec}, chunk int, start long, act array<array<double>>")


def _link(a: np.ndarray, b: np.ndarray, agreement: float) -> list[tuple[int, int, float]]:
    """(local speaker of a, of b, agreement) of the best assignment on shared frames. Agreement is the shared
    activity over the larger of the two; silent speakers have none."""
    most = np.maximum(np.maximum(a.sum(0)[:, None], b.sum(0)[None, :]), 1e-12)
    share = (a.T @ b) / most
    chosen = assignment(-share)
    return [(i, int(j), float(share[i, j])) for i, j in enumerate(chosen) if j >= 0 and share[i, j] >= agreement]


def links(activity: DataFrame, agreement: float = STITCH.agreement) -> DataFrame:
    """(rec, chunk, i, j, agreement): local speaker i of a chunk is j of the next one. Each chunk meets the
    next one only: two rows a task at a time."""
    following = activity.select("rec", (F.col("chunk") - 1).alias("chunk"), F.col("start").alias("start2"), F.col("act").alias("act2"))
    both = activity.join(following, ["rec", "chunk"])
    shift = (F.col("start2") - F.col("start")).cast("int")
    shared = both.select("rec", "chunk", F.slice("act", shift + 1, F.greatest(F.size("act") - shift, F.lit(0))).alias("a"), F.slice("act2", F.lit(1), F.greatest(F.size("act") - shift, F.lit(0))).alias("b"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for rec, chunk, a, b in zip(part.rec, part.chunk, part.a, part.b):
                n = min(len(a), len(b))
                if n:
                    out += [(rec, chunk, *x) for x in _link(np.stack(a[:n]), np.stack(b[:n]), agreement)]
            yield pd.DataFrame(out, columns=["rec", "chunk", "i", "j", "agreement"])

    rec = activity.schema["rec"].dataType.simpleString()
    return shared.mapInPandas(run, f"rec {rec}, chunk int, i int, j int, agreement double")


#: A local speaker's number in its recording: chunk x this + local speaker.
LOCALS = 64


def tracks(activity: DataFrame, linked: DataFrame) -> DataFrame:
    """(rec, chunk, i, track): the track of every local speaker, named by its first one."""
    local = activity.select("rec", "chunk", F.explode(F.sequence(F.lit(0), F.size(F.element_at("act", 1)) - 1)).alias("i"))
    number = lambda chunk, i: (chunk.cast("long") * LOCALS + i)
    nodes = local.select("rec", number(F.col("chunk"), F.col("i")).alias("i"))
    edges = linked.select("rec", number(F.col("chunk"), F.col("i")).alias("i"), number(F.col("chunk") + 1, F.col("j")).alias("j"))
    found = graphs.components(nodes, edges)
    return found.select("rec", F.floor(F.col("i") / LOCALS).cast("int").alias("chunk"), (F.col("i") % LOCALS).cast("int").alias("i"), F.col("component").alias("track"))


def by_voice(found: DataFrame, voices: DataFrame, distance: float = STITCH.voice_distance, speakers: int | None = None) -> DataFrame:
    """tracks with speaker in place of track: tracks are joined where the means of their voices (rec, chunk,
    i, embedding, weight) are near. A track without a voice keeps its own number. One recording's tracks
    are one group."""
    weighed = found.join(voices.where("embedding is not null and weight > 0"), ["rec", "chunk", "i"]).select("rec", "track", "weight", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    mean = weighed.groupBy("rec", "track", "d").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"))
    vectors = mean.groupBy("rec", "track").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda y: y.x).alias("v"))
    rec = found.schema["rec"].dataType.simpleString()

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("track")
        labels = clustering.agglomerative(np.array(group.v.tolist()), speakers, distance)
        first = group.track.to_numpy()[[int(np.flatnonzero(labels == k)[0]) for k in labels]]
        return pd.DataFrame({"rec": group.rec, "track": group.track, "speaker": first})

    joined = vectors.groupBy("rec").applyInPandas(one, f"rec {rec}, track long, speaker long")
    return found.join(joined, ["rec", "track"], "left").select("rec", "chunk", "i", F.coalesce("speaker", "track").alias("track"))


def overlap_add(activity: DataFrame, found: DataFrame) -> DataFrame:
    """(rec, track, f, p): each track's activity at every frame that one of its chunks covers, as a mean over
    all chunks that cover the frame, with weights that fall off towards a chunk's edges. A chunk in which
    the track isn't there counts 0; two local speakers of one chunk and track count the larger one."""
    n = F.size("act")
    weight = (F.lit(1.0) + F.least(F.col("pos"), n - 1 - F.col("pos"))) / n
    framed = activity.select("rec", "chunk", "start", "act", F.posexplode("act").alias("pos", "local"))
    at = framed.select("rec", "chunk", (F.col("start") + F.col("pos")).alias("f"), weight.alias("w"), "local")
    whole = at.groupBy("rec", "f").agg(F.sum("w").alias("whole"))
    each = at.select("rec", "chunk", "f", "w", F.posexplode("local").alias("i", "a")).join(found, ["rec", "chunk", "i"])
    own = each.groupBy("rec", "track", "f", "chunk").agg(F.max(F.col("w") * F.col("a")).alias("wa")).groupBy("rec", "track", "f").agg(F.sum("wa").alias("wa"))
    return own.join(whole, ["rec", "f"]).select("rec", "track", "f", (F.col("wa") / F.col("whole")).alias("p"))


def overlapping_turns(scores: DataFrame, config: StitchConfig = STITCH) -> DataFrame:
    """(rec, seg, s, e, label), in seconds, of scores (rec, track, f, p): runs of frames at onset or more.
    Segments are numbered by start; those of different labels may overlap."""
    keyed = scores.select(F.struct("rec", "track").alias("rec"), F.col("f").alias("i"), "p")
    runs = vad.runs(keyed, F.round("p", 9) >= config.onset)
    unit = config.frame / config.rate
    spans = runs.select("rec.rec", F.concat(F.lit("track"), F.col("rec.track").cast("string")).alias("label"), "run", (F.col("first") * unit).alias("s"), ((F.col("last") + 1) * unit).alias("e"))
    if config.collar:
        spans = turns.collar_merge(spans.withColumnRenamed("run", "seg"), config.collar).select("rec", "label", "s", "e")
    seg = F.row_number().over(Window.partitionBy("rec").orderBy("s", "e", "label"))
    return spans.select("rec", seg.alias("seg"), "s", "e", "label")


def diarize_overlapping(recordings: DataFrame, segmenter: Segmenter, voices: Callable[[DataFrame], DataFrame] | None = None, config: StitchConfig = STITCH) -> DataFrame:
    """Turns of recordings (rec, samples). voices gives the voices (see by_voice) of the local activity."""
    activity = cut(local_activity(recordings, segmenter, config))  # the model runs once
    found = tracks(activity, links(activity, config.agreement))
    if voices is not None:
        found = by_voice(found, voices(activity), config.voice_distance)
    return overlapping_turns(overlap_add(activity, found), config)
