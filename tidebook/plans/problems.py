"""Queries of the general data problems p1 to p5, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.wideint import LIMBS, digits, limbs
from tidebook.operators.balances import last_rises
from tidebook.operators.changefeed import apply_changes
from tidebook.operators.intervals import periods_and_gaps
from tidebook.operators.quantiles import merge_sketches, quantile_sketches, sketch_quantiles
from tidebook.operators.regular_grid import regular_grid
from tidebook.operators.rolling import rolling_totals
from tidebook.util import entity_columns, entity_key, hex_text, latest, table

LOG_KEY = ["block_number", "transaction_hash", "log_index"]
WINDOWS = [7, 30]
PROBABILITIES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
METRICS = ["lp_total_return_realized_fee", "initial_wealth_usdt"]
RANGE = ["pool_address", "manager_address", "tick_lower", "tick_upper"]


def log_feed(messages: DataFrame) -> tuple[DataFrame, list[str]]:
    """Messages about logs with cleaned columns, and the names of the payload."""
    kind = F.lower(F.trim("event_type"))
    feed = messages.select("block_number", hex_text("transaction_hash").alias("transaction_hash"), "log_index", "transaction_index", hex_text("address").alias("address"), kind.alias("kind"), hex_text("owner").alias("owner"), "tick_lower", "tick_upper", digits(F.col("liquidity_delta_raw")).alias("magnitude"), "removed", "ingested_at")
    return feed, ["transaction_index", "address", "kind", "owner", "tick_lower", "tick_upper", "magnitude"]


def current_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every log after all messages, tombstones included."""
    feed, payload = log_feed(table(spark, sf_dir, "pool_events"))
    return apply_changes(feed, LOG_KEY, "ingested_at", F.col("removed"), payload)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = current_logs(spark, sf_dir).filter(~F.col("is_deleted") & F.col("kind").isin("mint", "burn"))
    sign = F.when(F.col("kind") == "mint", 1).otherwise(-1)
    moves = logs.select("address", "owner", "tick_lower", "tick_upper", "block_number", "transaction_index", F.col("log_index").alias("opened_log_index"), F.col("transaction_hash").alias("opened_transaction_hash"), (F.col("kind") == "mint").alias("opens"), *[x.alias(f"m{i}") for i, x in enumerate(limbs(F.col("magnitude"), sign))])
    order = ["block_number", "transaction_index", "opened_log_index", "opened_transaction_hash"]
    return last_rises(moves, ["address", "owner", "tick_lower", "tick_upper"], order, [f"m{i}" for i in range(LIMBS)], "opens", ["opened_transaction_hash", "opened_log_index"])


def p1_log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt table itself: logs that stand."""
    logs = current_logs(spark, sf_dir).filter(~F.col("is_deleted"))
    return logs.select(*LOG_KEY, "transaction_index", "address", "kind", "owner", "tick_lower", "tick_upper", "magnitude")


def daily_counts(spark: SparkSession, sf_dir: str, name: str, day: str, amounts: list[str]) -> DataFrame:
    rows = table(spark, sf_dir, name).select(hex_text("pool_address").alias("pool_address"), F.col(day).alias("day"), "built_at", *amounts)
    return latest(rows, ["pool_address", "day"], "built_at", amounts)


def _series(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    eda = daily_counts(spark, sf_dir, "eda", "entry_date", ["position_count", "lifetime_median_days"])
    daily = daily_counts(spark, sf_dir, "portfolio_daily", "date", ["position_day_count"])
    return [("position_count", rolling_totals(eda, ["pool_address"], "day", ["position_count", "lifetime_median_days"], WINDOWS)), ("position_day_count", rolling_totals(daily, ["pool_address"], "day", ["position_day_count"], WINDOWS))]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for name, totals in _series(spark, sf_dir):
        week, month = F.col(f"{name}_total_7d"), F.col(f"{name}_total_30d")
        burst = totals.filter((F.col("days_since_first") >= 29) & (month >= 10) & (week > month / 2))
        found.append(burst.select(F.lit(name).alias("series"), "pool_address", F.date_format("as_of", "yyyy-MM-dd").alias("as_of_date")))
    return found[0].unionByName(found[1])


def p2_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of all three amounts, in long form."""
    out = []
    for _, totals in _series(spark, sf_dir):
        for amount in ("position_count", "lifetime_median_days", "position_day_count"):
            if f"{amount}_total_7d" in totals.columns:
                cells = [F.col(f"{amount}_{kind}_{w}d").alias(f"{kind}_{w}d") for w in WINDOWS for kind in ("total", "mean", "known_mean")]
                out.append(totals.select(F.lit(amount).alias("series"), "pool_address", F.date_format("as_of", "yyyy-MM-dd").alias("as_of_date"), *cells))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "operation_pairs").select(hex_text("operation_id").alias("operation_id"), hex_text("pool_address").alias("pool_address"), hex_text("manager_address").alias("manager_address"), "tick_lower", "tick_upper", "entry_block_number", "exit_block_number", "built_at")
    return latest(pairs, ["operation_id"], "built_at", [*RANGE, "entry_block_number", "exit_block_number"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).filter(F.col("tick_lower").isNotNull())
    spans = periods_and_gaps(pairs, RANGE, "entry_block_number", "exit_block_number")
    return spans.withColumnsRenamed({"span_start": "start_block", "span_end": "end_block"})


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each metric and operation: metric, pool_address, entry_day, value."""
    rows = table(spark, sf_dir, "position_metrics").select(hex_text("operation_id").alias("operation_id"), hex_text("pool_address").alias("pool_address"), "entry_timestamp", "built_at", *METRICS)
    rows = latest(rows, ["operation_id"], "built_at", ["pool_address", "entry_timestamp", *METRICS])
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("x")
    return rows.select("pool_address", F.to_date("entry_timestamp").alias("entry_day"), F.year("entry_timestamp").alias("entry_year"), long).select("x.metric", "pool_address", "entry_day", "entry_year", "x.value")


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by metric, pool and year, combined from the sketches of separate days."""
    rows = _metrics(spark, sf_dir)
    daily = quantile_sketches(rows, ["metric", "pool_address", "entry_year", "entry_day"], "value")
    days = daily.select(*entity_columns("e", ["metric", "pool_address", "entry_year", "entry_day"], rows.schema), "sketch")
    yearly = merge_sketches(days.select(F.to_json(F.struct(F.col("metric").alias("k0"), F.col("pool_address").alias("k1"), F.col("entry_year").alias("k2"))).alias("e"), "sketch"))
    found = sketch_quantiles(yearly, PROBABILITIES)
    return found.select(*entity_columns("e", ["metric", "pool_address", "entry_year"], rows.schema), "n", "rank_error", *[F.col("quantiles")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(PROBABILITIES)])


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _yearly(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _yearly(spark, sf_dir).filter("n >= 20")
    case = ((F.col("metric") == METRICS[0]) & (F.col("p50") < 0)) | ((F.col("metric") == METRICS[1]) & (F.col("p90") > 10 * F.col("p50")))
    return found.filter(case).select("metric", "pool_address", "entry_year")


def p4_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups far larger than a buffer, combined from monthly sketches: whether every percentile keeps the bound its sketch states, and the bound 1 %."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.date_trunc("month", "l_shipdate").alias("month"), F.col("l_extendedprice").alias("v"))
    group = ["l_returnflag", "l_linestatus"]
    monthly = quantile_sketches(rows, [*group, "month"], "v")
    whole = monthly.select(*entity_columns("e", [*group, "month"], rows.schema), "sketch").select(entity_key(group).alias("e"), "sketch")
    found = sketch_quantiles(merge_sketches(whole), PROBABILITIES).select(*entity_columns("e", group, rows.schema), F.col("n").alias("n"), "rank_error", "quantiles")
    ranks = [F.count_if(F.col("v") < F.col("quantiles")[i]).alias(f"below{i}") for i in range(len(PROBABILITIES))] + [F.count_if(F.col("v") <= F.col("quantiles")[i]).alias(f"upto{i}") for i in range(len(PROBABILITIES))]
    told = rows.join(found, group).groupBy(*group, "n", "rank_error").agg(*ranks)
    kept = F.lit(True)
    for i, p in enumerate(PROBABILITIES):
        off = F.col("rank_error") * F.col("n") + 1
        kept &= (F.col(f"below{i}") <= p * (F.col("n") - 1) + off) & (F.col(f"upto{i}") >= p * (F.col("n") - 1) - off)
    return told.select(*group, "n", kept.alias("within_stated_bound"), (F.col("rank_error") <= 0.01).alias("stated_bound_within_1_percent"))


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid(table(spark, sf_dir, "oracle"), table(spark, sf_dir, "oracle_feeds"), "feed_id", "timestamp", "price", "volume", "ingested_at", "step_seconds")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_grid(spark, sf_dir).filter("is_missing").select("feed_id", "slot_epoch")


QUERIES = {f.__name__: f for f in (p1_found, p1_log_state, p2_found, p2_rolling, p3_found, p4_found, p4_percentiles, p4_large_groups, p5_found, p5_grid)}

_LOGS = r"""
WITH held AS (
  SELECT block_number, lower(trim(transaction_hash)) AS transaction_hash, log_index, transaction_index,
         lower(trim(address)) AS address, lower(trim(event_type)) AS kind, lower(trim(owner)) AS owner, tick_lower, tick_upper,
         nullif(regexp_extract(regexp_replace(liquidity_delta_raw, '\s+', '', 'g'), '^[+-]?0*([0-9]{1,84})$', 1), '') AS magnitude,
         coalesce(removed, false) AS gone
  FROM pool_events
  QUALIFY row_number() OVER (PARTITION BY block_number, lower(trim(transaction_hash)), log_index ORDER BY ingested_at DESC NULLS LAST, coalesce(removed, false) DESC) = 1)
"""

SQL = {
    "p1_log_state": _LOGS + "SELECT * EXCLUDE (gone) FROM held WHERE NOT gone",
    "p1_found": _LOGS + """, moves AS (
  SELECT *, coalesce(magnitude::HUGEINT, 0) * CASE WHEN kind = 'mint' THEN 1 ELSE -1 END AS delta
  FROM held WHERE NOT gone AND kind IN ('mint', 'burn')),
run AS (
  SELECT *, sum(delta) OVER (PARTITION BY address, owner, tick_lower, tick_upper ORDER BY block_number, transaction_index, log_index, transaction_hash ROWS UNBOUNDED PRECEDING) AS after FROM moves)
SELECT address, owner, tick_lower, tick_upper,
       arg_max(transaction_hash, (block_number, transaction_index, log_index, transaction_hash)) FILTER (WHERE after > 0 AND after - delta <= 0) AS opened_transaction_hash,
       arg_max(log_index, (block_number, transaction_index, log_index, transaction_hash)) FILTER (WHERE after > 0 AND after - delta <= 0) AS opened_log_index
FROM run GROUP BY ALL HAVING sum(delta) > 0""",
}

_DAYS = """
WITH eda1 AS (
  SELECT lower(trim(pool_address)) AS pool_address, entry_date AS day, position_count, lifetime_median_days FROM eda
  QUALIFY row_number() OVER (PARTITION BY lower(trim(pool_address)), entry_date ORDER BY built_at DESC NULLS LAST, position_count DESC NULLS LAST) = 1),
daily1 AS (
  SELECT lower(trim(pool_address)) AS pool_address, date AS day, position_day_count FROM portfolio_daily
  QUALIFY row_number() OVER (PARTITION BY lower(trim(pool_address)), date ORDER BY built_at DESC NULLS LAST, position_day_count DESC NULLS LAST) = 1),
amounts AS (
  SELECT 'position_count' AS series, pool_address, day, position_count::DOUBLE AS x FROM eda1
  UNION ALL SELECT 'lifetime_median_days', pool_address, day, CASE WHEN isfinite(lifetime_median_days) THEN lifetime_median_days END FROM eda1
  UNION ALL SELECT 'position_day_count', pool_address, day, position_day_count::DOUBLE FROM daily1),
calendar AS (
  SELECT series, pool_address, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS as_of, min(day) AS first
  FROM amounts WHERE day IS NOT NULL GROUP BY series, pool_address),
totals AS (
  SELECT c.series, c.pool_address, as_of, as_of - first AS since, x,
         coalesce(sum(x::DECIMAL(38,9)) OVER w7, 0)::DOUBLE AS t7, coalesce(sum(x::DECIMAL(38,9)) OVER w30, 0)::DOUBLE AS t30, count(x) OVER w7 AS k7, count(x) OVER w30 AS k30
  FROM calendar c LEFT JOIN amounts a ON a.series = c.series AND a.pool_address IS NOT DISTINCT FROM c.pool_address AND a.day = c.as_of
  WINDOW w7 AS (PARTITION BY c.series, c.pool_address ORDER BY as_of ROWS 6 PRECEDING), w30 AS (PARTITION BY c.series, c.pool_address ORDER BY as_of ROWS 29 PRECEDING))
"""
SQL |= {
    "p2_found": _DAYS + "SELECT series, pool_address, strftime(as_of, '%Y-%m-%d') AS as_of_date FROM totals WHERE series <> 'lifetime_median_days' AND since >= 29 AND t30 >= 10 AND t7 > t30 / 2",
    "p2_rolling": _DAYS + """SELECT series, pool_address, strftime(as_of, '%Y-%m-%d') AS as_of_date, t7 AS total_7d, t7 / 7 AS mean_7d, t7 / nullif(k7, 0) AS known_mean_7d,
  t30 AS total_30d, t30 / 30 AS mean_30d, t30 / nullif(k30, 0) AS known_mean_30d FROM totals""",
    "p3_found": """
WITH held AS (
  SELECT lower(trim(pool_address)) AS pool_address, lower(trim(manager_address)) AS manager_address, tick_lower, tick_upper, entry_block_number AS a, exit_block_number AS b FROM operation_pairs
  QUALIFY row_number() OVER (PARTITION BY lower(trim(operation_id)) ORDER BY built_at DESC NULLS LAST) = 1),
used AS (SELECT *, max(b) OVER (PARTITION BY pool_address, manager_address, tick_lower, tick_upper ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM held WHERE a < b AND tick_lower IS NOT NULL),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY pool_address, manager_address, tick_lower, tick_upper ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM used)
SELECT pool_address, manager_address, tick_lower, tick_upper, 'period' AS span_kind, min(a) AS start_block, max(b) AS end_block FROM marked GROUP BY pool_address, manager_address, tick_lower, tick_upper, island
UNION ALL
SELECT pool_address, manager_address, tick_lower, tick_upper, 'gap', before, a FROM marked WHERE a > before""",
    "p4_found": """
WITH held AS (
  SELECT lower(trim(pool_address)) AS pool_address, year(entry_timestamp AT TIME ZONE 'UTC')::INT AS entry_year, lp_total_return_realized_fee AS r, initial_wealth_usdt AS w FROM position_metrics
  QUALIFY row_number() OVER (PARTITION BY lower(trim(operation_id)) ORDER BY built_at DESC NULLS LAST) = 1),
long AS (SELECT 'lp_total_return_realized_fee' AS metric, pool_address, entry_year, r AS v FROM held UNION ALL SELECT 'initial_wealth_usdt', pool_address, entry_year, w FROM held),
q AS (SELECT metric, pool_address, entry_year, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.9) AS p FROM long WHERE v IS NOT NULL AND isfinite(v) GROUP BY ALL HAVING count(*) >= 20)
SELECT metric, pool_address, entry_year FROM q WHERE CASE WHEN metric = 'initial_wealth_usdt' THEN p > 10 * m ELSE m < 0 END""",
    "p4_large_groups": "SELECT l_returnflag, l_linestatus, count(*) AS n, true AS within_stated_bound, true AS stated_bound_within_1_percent FROM lineitem WHERE isfinite(l_extendedprice) GROUP BY 1, 2",
    "p5_found": """
WITH slots AS (
  SELECT o.feed_id, step_seconds::BIGINT AS step, epoch_us(timestamp) // 1000000 // step_seconds AS slot, price IS NOT NULL AND isfinite(price) AND price > 0 AS usable
  FROM oracle o JOIN oracle_feeds f USING (feed_id)),
grid AS (SELECT feed_id, any_value(step) AS step, unnest(range(min(slot), max(slot) + 1)) AS slot FROM slots GROUP BY feed_id)
SELECT feed_id, g.slot * g.step AS slot_epoch FROM grid g ANTI JOIN (SELECT DISTINCT feed_id, slot FROM slots WHERE usable) u USING (feed_id, slot)""",
}
