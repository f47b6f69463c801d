"""The same events as they arrive: windowed activity with a watermark, and change feeds in micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators.changefeed import apply_changes


def hourly_activity(events: DataFrame, at: str, key: str, kind: str, delay: str = "10 minutes") -> DataFrame:
    """Events and distinct keys by hour and kind, once a late event can no longer come.

    Repeated deliveries of a key within the delay count once. State is bounded by the watermark.
    """
    rows = events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    counts = rows.groupBy(F.window(at, "1 hour").alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return counts.select(F.unix_timestamp("w.start").alias("hour_start"), "kind", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what a stream now holds to a table and stop."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()


def apply_stream(stream: DataFrame, key: list[str], sequence: str, deleted: Column, payload: list[str], root: str, checkpoint: str) -> None:
    """Apply a stream of messages to the table published under ``root``, one atomic publication a micro-batch.

    A repeated batch changes nothing, since stored sequences are compared, so the sink is exactly-once.
    """
    def each(batch: DataFrame, _: int) -> None:
        apply_changes(batch, key, sequence, deleted, payload, root)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
