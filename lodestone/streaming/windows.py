"""Event-time windows; every function takes a batch or a stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs a time with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums of `value` per window and event_type; sliding if `slide` is given. On a stream, rows later than `late` are dropped."""
    g = _timed(events, late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Events of a user that follow each other within `gap`."""
    g = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "n")


def ingest(stream: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append records that weren't seen before, by id; a restart goes on where it stopped. The ids seen are state that grows."""
    return stream.dropDuplicates([key]).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_log(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A JSON log of rows as they come."""
    return stream.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stage_totals(rows: DataFrame) -> DataFrame:
    """Accumulated time of each stage."""
    return rows.groupBy("stage").agg(F.sum("ms").alias("ms"), F.count("*").alias("n"))


class Progress(StreamingQueryListener):
    """Calls back with (rows so far, rows of the batch) after each micro-batch of any query; add it by `spark.streams.addListener`."""

    def __init__(self, on_progress: Callable[[int, int], None]):
        self.on_progress, self.total = on_progress, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.total += event.progress.numInputRows
        self.on_progress(self.total, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class Stopwatch:
    """Adds up the time of stages by name: `with watch("sparse"): ...`, as often as a stage runs."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock, self.ms, self.n = clock, {}, {}

    @contextmanager
    def __call__(self, stage: str) -> Iterator[None]:
        began = self.clock()
        try:
            yield
        finally:
            self.ms[stage] = self.ms.get(stage, 0.0) + (self.clock() - began) * 1000
            self.n[stage] = self.n.get(stage, 0) + 1
