"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators.changefeed import current_version
from tidebook.plans.problems import LOG_KEY, SQL as _PROBLEMS, log_feed
from tidebook.sources.files import column_extent, content_hash, read_text_table, stream_table, write_once, write_text_table
from tidebook.streaming.activity import apply_stream, hourly_activity, run_available
from tidebook.util import fresh_path, table


def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """A table written as compressed text and read back as text."""
    path = fresh_path(spark, "csv")
    write_text_table(table(spark, d, "supplier"), path)
    return read_text_table(spark, path).select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


def written_once(spark: SparkSession, d: str) -> DataFrame:
    """A table written twice: the second time it is found unchanged; rows and the agreement of contents."""
    path, rows = fresh_path(spark, "once"), table(spark, d, "nation")
    first, second = write_once(rows, path), write_once(rows, path)
    again = content_hash(spark.read.parquet(path)).select(F.col("content_hash").alias("other"))
    return content_hash(rows).join(F.broadcast(again), F.lit(True)).select("rows", (F.col("content_hash") == F.col("other")).alias("same"), F.lit(first).alias("first_written"), F.lit(second).alias("second_written"))


def column_extents(spark: SparkSession, d: str) -> DataFrame:
    return column_extent(table(spark, d, "operation_pairs"), ["entry_block_number", "exit_block_number", "tick_lower"])


def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts from a stream of the events table, up to the watermark."""
    at = F.timestamp_seconds(F.unix_timestamp("ts"))
    events = stream_table(spark, d, "events").select(at.alias("at"), "event_id", "event_type")
    path = fresh_path(spark, "activity")
    run_available(hourly_activity(events, "at", "event_id", "event_type"), path, fresh_path(spark, "activity-log"))
    return spark.read.schema("hour_start bigint, kind string, n bigint").parquet(path)


def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """The change feed of p1 applied as a stream: the same state."""
    feed, payload = log_feed(stream_table(spark, d, "pool_events"))
    root = fresh_path(spark, "changes")
    apply_stream(feed, LOG_KEY, "ingested_at", F.col("removed"), payload, root, fresh_path(spark, "changes-log"))
    logs = spark.read.parquet(current_version(spark, root)).filter(~F.col("is_deleted"))
    return logs.select(*LOG_KEY, *payload)


QUERIES = {f.__name__: f for f in (csv_scan, written_once, column_extents, stream_activity, stream_changes)}
SQL = {
    "csv_scan": "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_acctbal FROM supplier",
    "written_once": "SELECT count(*) AS rows, true AS same, true AS first_written, false AS second_written FROM nation",
    "column_extents": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest FROM operation_pairs" for c in ("entry_block_number", "exit_block_number", "tick_lower")),
    "stream_activity": "WITH e AS (SELECT floor(epoch(ts))::BIGINT AS sec, event_type FROM events) SELECT sec // 3600 * 3600 AS hour_start, event_type AS kind, count(*) AS n FROM e WHERE sec // 3600 * 3600 + 3600 <= (SELECT max(sec) FROM e) - 600 GROUP BY 1, 2",
    "stream_changes": _PROBLEMS["p1_log_state"],
}
