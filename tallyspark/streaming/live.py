"""Live state with time-outs, and the stream of an analysis's stage events until it ends."""

from __future__ import annotations

import queue
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..operators.store import TERMINAL

LIVE = "key string, status string, value string, at timestamp"
CURRENT, EXPIRED = "current", "expired"


class LatestWithin(StatefulProcessor):
    """The latest value of each key, which ends when the watermark has passed its time by `keep_ms`.

    A repeated event, one that is older than what is held, and of equal times one with a smaller value, change nothing and yield no row.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at_ms long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = before = self.held.get() if self.held.exists() else None
        for frame in rows:
            for at, value in zip(frame["at_ms"], frame["value"]):
                if best is None or (int(at), value) > tuple(best):
                    best = (int(at), value)
        if best is not None and (before is None or tuple(best) != tuple(before)):
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.held.update(tuple(best))
            self.handle.registerTimer(best[0] + self.keep_ms)
            yield self._row(key, CURRENT, best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            last = tuple(self.held.get())
            self.held.clear()
            yield self._row(key, EXPIRED, last)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, status: str, held: tuple) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "status": [status], "value": [held[1]], "at": [pd.Timestamp(held[0], unit="ms")]})


def latest_within(events: DataFrame, key: str, value: str, time: str, keep: str = "7 days", late: str = "1 hour") -> DataFrame:
    """(key, status, value, at) of a stream: each change of a key's latest value as `current`, and its end, `keep` after its time, as `expired`.

    Keys live in a state store (RocksDB) and go with their time-out, so state doesn't grow with all keys ever seen. Events over `late`
    behind the newest are dropped; rows with a null key, value or time take no part.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), F.col(time).cast("timestamp").alias("at")).where("key is not null and value is not null and at is not null")
    rows = rows.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return rows.groupBy("key").transformWithStateInPandas(LatestWithin(keep_ms), LIVE, "Update", "EventTime")


class _Ended(StreamingQueryListener):
    """Tells a queue when a query has ended, and why."""

    def __init__(self, told: queue.Queue, run: list[str]):
        self.told, self.run = told, run

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.run:
            self.told.put(("ended", event.exception))


def follow(spark: SparkSession, events: DataFrame, analysis_id: str, checkpoint: str, terminal: tuple[str, ...] = TERMINAL, trigger: str = "1 second") -> Iterator[dict]:
    """The events (analysis_id, stage, status, at) of one analysis as they come, in order of time within a batch, until one has a terminal status.

    A micro-batch hands its rows of this analysis on; a listener tells of a query that ends by itself, whose fault is raised. A batch that runs again
    after a restart is told once. The query is stopped when the events end or the caller stops asking.
    """
    told: queue.Queue = queue.Queue()
    seen: set[int] = set()

    def hand_on(batch: DataFrame, number: int) -> None:
        if number not in seen:
            seen.add(number)
            for row in batch.orderBy("at", "stage").toLocalIterator():
                told.put(("event", row.asDict()))

    run: list[str] = []
    listener = _Ended(told, run)
    spark.streams.addListener(listener)
    mine = events.where(F.col("analysis_id") == analysis_id).select("analysis_id", "stage", "status", "at")
    query: StreamingQuery = mine.writeStream.foreachBatch(hand_on).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
    run.append(str(query.runId))
    try:
        while True:
            try:
                kind, what = told.get(timeout=1)
            except queue.Empty:
                if not query.isActive and told.empty():
                    kind, what = "ended", query.exception()
                else:
                    continue
            if kind == "ended":
                if what:
                    raise RuntimeError(f"the stream of {analysis_id} ended: {what}")
                return
            yield what
            if what["status"] in terminal:
                return
    finally:
        query.stop()
        spark.streams.removeListener(listener)
