"""Streaming forms of the two stateful operators: latest verdicts, and cohort samples replaced by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import record_samples


def latest_by_key(events: DataFrame, keys: list[str], value: str, time: str, tie: str | None = None) -> DataFrame:
    """The last value of each key, as an update stream; of equal times that of the largest `tie` (else of the largest value).

    The state is one row for each key and stays, as a later event of any key may come at any time; a row that comes late
    changes nothing, as its time is not the last.
    """
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(time, tie or value)).alias(value), F.max(time).alias(time))


def windowed_counts(events: DataFrame, time: str, keys: list[str], length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and key; state ends with the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))


def upsert_cohort_samples(samples: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes samples so that a document's newest batch replaces its earlier ones; a batch that runs again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        record_samples(batch, path)

    writer = samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
