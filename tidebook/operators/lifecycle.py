"""Life cycles of positions and daily activity, each in one pass of conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(kind: str, column: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0)).cast("bigint")


def balance_table(events: DataFrame, identity: list[str]) -> DataFrame:
    """One row a position: counts and sums by kind of event, its first and last events and the number of depths."""
    counts = [F.count_if(F.col("kind") == k).alias(f"{k.lower()}_count") for k in ("Mint", "Burn", "Collect")]
    sums = [_sum(k, c).alias(n) for n, k, c in (("liquidity_in", "Mint", "depth"), ("liquidity_out", "Burn", "depth"), ("deposited", "Mint", "cents"), ("withdrawn", "Burn", "cents"), ("collected", "Collect", "cents"))]
    ends = [F.min(F.when(F.col("kind") == "Mint", F.col("order_key"))).alias("first_mint_key"), F.max(F.when(F.col("kind") == "Burn", F.col("order_key"))).alias("last_burn_key"), F.min_by("log_index", "order_key").alias("first_log_index"), F.max_by("log_index", "order_key").alias("last_log_index")]
    return events.groupBy(*identity).agg(*counts, *sums, *ends, F.count_distinct("depth").alias("depths"))


def daily_activity(events: DataFrame) -> DataFrame:
    """Counts, sums and the first and last trade of each day; days without trades keep nulls."""
    kinds = ("Swap", "Mint", "Burn", "Collect")
    swap = F.col("kind") == "Swap"
    counts = [F.count_if(F.col("kind") == k).alias(f"{k.lower()}_count") for k in kinds]
    sums = [_sum(k, "cents").alias(f"{k.lower()}_cents") for k in kinds]
    ends = [F.min(F.when(swap, F.col("sec"))).alias("first_swap_sec"), F.max(F.when(swap, F.col("sec"))).alias("last_swap_sec"), F.min_by("price", F.when(swap, F.col("order_key"))).alias("open_price"), F.max_by("price", F.when(swap, F.col("order_key"))).alias("close_price")]
    return events.groupBy(F.expr("sec div 86400").alias("day_number")).agg(*counts, *sums, *ends)
