"""Frames in event-time order from a stream in any order: keyed state waits for the watermark, and late frames are kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from granary.operators.retain import offer, retain

FRAME = "score double, seconds double, hash long, id long"
OUTPUT = f"source long, {FRAME}, late boolean"


class Ordered(StatefulProcessor):
    """The best frames of one source, offered in time order whatever order they come in.

    State: the kept frames, those that wait for the watermark, and the place in time up to which frames have been
    offered. A timer at the time of the first waiting frame fires once the watermark is past it. A frame before a place
    that has been offered is late: it changes nothing here and is handed on as it is. Each batch that touches a source
    gives its best frames so far, as if all that wait were offered now.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", FRAME)
        self.waiting = handle.getListState("waiting", FRAME)
        self.offered = handle.getValueState("offered", "seconds double, id long")

    def settle(self, source: int, news: list[tuple], watermark: float, late: list[tuple]) -> pd.DataFrame:
        kept = list(self.kept.get()) if self.kept.exists() else []
        waiting = sorted([*(self.waiting.get() if self.waiting.exists() else ()), *news], key=lambda x: (x[1], x[3]))
        ready = [x for x in waiting if x[1] < watermark]
        for frame in ready:
            kept = offer(kept, frame)
        if ready:
            self.offered.update((ready[-1][1], ready[-1][3]))
        waiting = waiting[len(ready) :]
        self.kept.put(kept) if kept else self.kept.clear()
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting:
            self.handle.registerTimer(int(waiting[0][1] * 1000) + 1)
        for frame in waiting:
            kept = offer(kept, frame)
        rows = [(source, *x, False) for x in kept] + [(source, *x, True) for x in late]
        return pd.DataFrame(rows, columns=["source", "score", "seconds", "hash", "id", "late"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        place = self.offered.get() if self.offered.exists() else None
        news, late = [], []
        for part in rows:
            for row in part.itertuples(index=False):
                frame = (float(row.score), float(row.seconds), int(row.hash), int(row.id))
                (late if place is not None and (frame[1], frame[3]) <= (place[0], place[1]) else news).append(frame)
        yield self.settle(key[0], news, timerValues.getCurrentWatermarkInMs() / 1000, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.settle(key[0], [], timerValues.getCurrentWatermarkInMs() / 1000, [])

    def close(self) -> None:
        pass


def retain_stream(frames: DataFrame, time: Column, delay: str = "10 minutes") -> DataFrame:
    """For a stream of (source, id, seconds, score, hash) and its event time: OUTPUT, a source's best frames after each
    batch that touches it, and its late frames once, as they come. Needs the RocksDB state store.

    `delay` says how long frames wait for earlier ones: the more, the fewer come late, and the more wait in the state. No
    frame is dropped for being late, as the time itself isn't among the columns that reach the state.
    """
    timed = frames.withColumn("_time", time).withWatermark("_time", delay).select("source", "id", "seconds", "score", "hash")
    return timed.groupBy("source").transformWithStateInPandas(Ordered(), OUTPUT, "Update", "EventTime")


def mended(found: DataFrame, frames: DataFrame) -> DataFrame:
    """source, id and score of what a stream kept, equal to `retain` of all its frames.

    found holds OUTPUT of all batches and `batch`; frames, the frames that the stream has read. Only sources with late
    frames are read again, from their first frame on; the others' state is right as it is.
    """
    late = found.filter("late").select("source").distinct()
    last = found.filter(~F.col("late")).groupBy("source").agg(F.max("batch").alias("batch"))
    kept = found.filter(~F.col("late")).join(last, ["source", "batch"]).join(late, "source", "left_anti")
    return kept.select("source", "id", "score").unionByName(retain(frames.join(late, "source", "left_semi")))
