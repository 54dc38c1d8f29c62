"""Streams of frame scores and labelled intervals."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from vocaris.operators.vad import VAD, VadConfig


def sessions(intervals: DataFrame, gap: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """Per recording and label, intervals (rec, label, ts) closer than gap as one session, once the
    watermark has passed it. Later rows are dropped."""
    stamped = intervals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = stamped.groupBy("rec", "label", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("rec", "label", F.col("w.start").alias("s"), F.col("w.end").alias("e"), "n")


def speech_seconds(intervals: DataFrame, width: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Rows and seconds by label and time window of intervals (label, ts, seconds)."""
    stamped = intervals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy("label", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds")).select("label", F.col("w.start").alias("s"), "n", "seconds")


#: Of a recording: the open utterance, the last frame used, and the frames that wait for earlier ones.
_STATE = "start long, quiet long, seen long, last long, timer long, frames array<long>, scores array<double>, stamps array<long>"
_FRESH = (-1, -1, -1, -1, -1, [], [], [])


class OnlineVad(StatefulProcessor):
    """The hysteresis of vad.hysteresis over frames (rec, i, p, ts) as they come.

    A frame waits until the watermark has passed its time, so that frames are used in order whatever
    order they came in; later ones are Spark's late rows. A timer uses what waits, a second one, idle
    after the last frame, ends the recording: speech that is open then ends with it, and the state goes.
    """

    def __init__(self, config: VadConfig, idle_ms: int):
        self.config, self.idle_ms = config, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recording", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        new = pd.concat(parts)
        state = self._get()
        # a stamp of whole milliseconds, as the watermark has
        stamps = new.ts.astype("datetime64[ms]").astype("int64")
        for column, values in zip(state[5:], (new.i, new.p, stamps)):
            column.extend(values.tolist())
        yield from self._advance(key, state, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return
        state = self._get()
        state[4] = -1  # this timer is gone
        yield from self._advance(key, state, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _get(self) -> list:
        found = self.state.get() if self.state.exists() else _FRESH
        return [*found[:5], *[list(x) for x in found[5:]]]

    def _advance(self, key, state: list, watermark: int) -> Iterator[pd.DataFrame]:
        found = self._use(state, watermark)
        waiting, last = state[7], state[3]
        # the watermark is a bound below which no row comes any more: rows at it may still come
        over = not waiting and last >= 0 and last + self.idle_ms < watermark
        if state[4] >= 0:
            self.handle.deleteTimer(state[4])
        if over:
            if state[0] >= 0:
                found.append((state[0], (state[2] + 1) * self.config.frame))
            self.state.clear()
        else:
            state[4] = max(max(waiting) if waiting else last + self.idle_ms, watermark) + 1
            self.handle.registerTimer(state[4])
            self.state.update(tuple(state))
        if found:
            yield pd.DataFrame({"rec": key[0], "s": [s for s, _ in found], "e": [e for _, e in found]})

    def _use(self, state: list, watermark: int) -> list[tuple[int, int]]:
        """Closed speech of the waiting frames that the watermark has passed; the others stay."""
        start, quiet, seen, last, config, found = *state[:4], self.config, []
        waiting = sorted(zip(*state[5:]))
        ready = [x for x in waiting if x[2] < watermark]
        state[5:] = [list(c) for c in zip(*[x for x in waiting if x[2] >= watermark])] or [[], [], []]
        for i, p, stamp in ready:
            last = max(last, stamp)
            if i <= seen:
                continue
            seen, at = i, i * config.frame
            if p >= config.threshold:
                quiet = -1
                start = at if start < 0 else start
            elif p < config.threshold - config.negative_gap and start >= 0:
                quiet = at if quiet < 0 else quiet
                if at - quiet >= config.min_silence:
                    if quiet - start > config.min_speech:
                        found.append((start, quiet))
                    start = quiet = -1
        state[:4] = [start, quiet, seen, last]
        return found


def online_vad(frames: DataFrame, config: VadConfig = VAD, late: str = "10 seconds", idle: str = "1 minute") -> DataFrame:
    """Speech (rec, s, e) of a stream of frames (rec, i, p, ts), as soon as it closes, as vad.hysteresis has
    it. Frames may come out of order by up to ``late``; of those that come later, late_rows() has the
    number. A recording is over once ``idle`` has passed without a frame of it: what is open closes with
    its last frame, and nothing of it is kept. Rows with a null rec only move the clock.

    State is three numbers and the waiting frames of each open recording. Start the query inside
    keyed_state(), as timers need it.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    stamped = frames.select("rec", F.col("i").cast("long").alias("i"), F.col("p").cast("double").alias("p"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rec = frames.schema["rec"].dataType.simpleString()
    # reads ts too, so that it stays above the watermark, which must see every row
    known = stamped.where(F.when(F.col("ts").isNotNull(), F.col("rec").isNotNull()))
    return known.groupBy("rec").transformWithStateInPandas(OnlineVad(config, idle_ms), f"rec {rec}, s long, e long", "Append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's setting is put back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old) if old is not None else spark.conf.unset(name)


class LateRows(StreamingQueryListener):
    """Counts rows that came behind the watermark, by query: ``spark.streams.addListener(LateRows())``."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.counts[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        self.counts[str(progress.id)] = self.counts.get(str(progress.id), 0) + sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def late_rows(query: StreamingQuery) -> int:
    """Rows behind the watermark in the progress that the query still remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def run_once(stream: DataFrame, folder: str, name: str = "stream") -> DataFrame:
    """What a stream of files that are there already gives, as a table under a shared folder. A run that
    was stopped goes on where it was."""
    spark = stream.sparkSession
    with keyed_state(spark):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}")
