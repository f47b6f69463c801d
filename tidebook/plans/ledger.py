"""The ledger view of the ``events`` table that the ordered-event queries run on, and its SQL.

signup opens a position, purchase closes one, click and view are trades, error is a collection.
A block lasts 12 seconds and carries one time, its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators.matching import fifo_pairs, join_pairs
from tidebook.operators.ordered import PER_TRANSACTION, block_position_key, order_key
from tidebook.util import table

BLOCK_SECONDS = 12
KEY = ["wallet", "tick_lower", "tick_upper", "depth"]
BASE = ["wallet", "tick_lower", "tick_upper"]
CARRIED = ["sec", "cents", "transaction_index", "block_number"]
#: Stretch widths: two hours of seconds, and the order keys of 600 blocks.
SECONDS_WIDTH, KEY_WIDTH = 7_200, 600 * 10**10
#: Operations are fewer than trades: stretches of 38,400 blocks.
MATCH_WIDTH = 64 * KEY_WIDTH


#: Decisions of ``_packs`` by table version, so that a query asks once.
_PACKS: dict[tuple, bool] = {}


def _packs(rows: DataFrame, spark: SparkSession, path: str) -> bool:
    """Whether the order parts of the whole table can be packed as they are."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    version = (spark.sparkContext.applicationId, path, status.getModificationTime(), status.getLen())
    if version not in _PACKS:
        parts = (F.col(c).between(0, PER_TRANSACTION - 1) for c in ("transaction_index", "log_index"))
        _PACKS[version] = rows.agg(F.coalesce(F.bool_and(next(parts) & next(parts)), F.lit(True))).first()[0]
    return _PACKS[version]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in order; any number of rows and any ids."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "signup", "Mint").when(F.col("event_type") == "purchase", "Burn").when(F.col("event_type") == "error", "Collect").otherwise("Swap")
    block = F.expr(f"unix_timestamp(ts) div {BLOCK_SECONDS}")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_index"), F.col("user_id").alias("transaction_index"), block.alias("block_number"), (block * BLOCK_SECONDS).alias("sec"), kind.alias("kind"), "event_type",
        (F.col("user_id") % 20).alias("wallet"), (-100 * (1 + k % 3)).alias("tick_lower"), (100 * (1 + k % 3)).alias("tick_upper"),
        F.when((F.col("event_type") == "purchase") & (k % 10 == 0), 0).otherwise(1 + k % 2).alias("depth"), F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.greatest("value", F.lit(0.01)).alias("price"))
    pack = order_key if _packs(rows, spark, f"{sf_dir}/events.parquet") else block_position_key
    return rows.withColumn("order_key", pack("block_number", "transaction_index", "log_index"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings and closings of positive depth."""
    return ledger(spark, sf_dir).filter(F.col("kind").isin("Mint", "Burn") & (F.col("depth") > 0)).withColumn("opens", F.col("kind") == "Mint")


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fifo_pairs(operations(spark, sf_dir), KEY, ["order_key"], "opens", "log_index", BASE, carry=CARRIED, width=MATCH_WIDTH)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a pair: the key, order keys, seconds, amounts and price bounds."""
    rows = join_pairs(matched(spark, sf_dir), KEY, "opens", ["log_index", "order_key", *CARRIED, "base_position"])
    scale = (F.col("tick_upper") / 100).cast("double")
    return rows.withColumns({"low": 10.0 * scale, "high": 60.0 * scale, "liquidity": F.col("depth").cast("double")})


def swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).filter("kind = 'Swap'").select("order_key", "block_number", "sec", "price", "cents")


L = """
l AS (
  SELECT event_id AS log_index, user_id AS transaction_index, sec // 12 AS block_number, sec // 12 * 12 AS sec,
         CASE event_type WHEN 'signup' THEN 'Mint' WHEN 'purchase' THEN 'Burn' WHEN 'error' THEN 'Collect' ELSE 'Swap' END AS kind, event_type,
         user_id % 20 AS wallet, (-100 * (1 + k % 3))::INT AS tick_lower, (100 * (1 + k % 3))::INT AS tick_upper,
         (CASE WHEN event_type = 'purchase' AND k % 10 = 0 THEN 0 ELSE 1 + k % 2 END)::INT AS depth,
         round(value * 100)::BIGINT AS cents, greatest(value, 0.01) AS price, sec // 12 * 10000000000 + user_id * 100000 + event_id AS order_key
  FROM (SELECT *, floor(epoch(ts))::BIGINT AS sec, (props->>'$.k')::INT AS k FROM events))"""

M = L + """,
walk AS (
  SELECT *, kind = 'Mint' AS opens, sum(CASE kind WHEN 'Mint' THEN 1 ELSE -1 END) OVER w AS s, row_number() OVER (PARTITION BY wallet, tick_lower, tick_upper ORDER BY order_key) AS base_position
  FROM l WHERE kind IN ('Mint', 'Burn') AND depth > 0 WINDOW w AS (PARTITION BY wallet, tick_lower, tick_upper, depth ORDER BY order_key)),
low AS (SELECT *, least(0, min(s) OVER w) AS m, coalesce(lag(s) OVER w, 0) AS s0 FROM walk WINDOW w AS (PARTITION BY wallet, tick_lower, tick_upper, depth ORDER BY order_key)),
low0 AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY wallet, tick_lower, tick_upper, depth ORDER BY order_key), 0) AS m0 FROM low),
hit AS (SELECT *, NOT opens AND m = m0 AS closed FROM low0),
numbered AS (
  SELECT *, CASE WHEN opens THEN sum(opens::INT) OVER w WHEN closed THEN sum(closed::INT) OVER w END AS n, sum(closed::INT) OVER (PARTITION BY wallet, tick_lower, tick_upper, depth) AS closes
  FROM hit WINDOW w AS (PARTITION BY wallet, tick_lower, tick_upper, depth ORDER BY order_key)),
matched AS (SELECT *, closed OR (opens AND n <= closes) AS is_matched FROM numbered),
pairs AS (
  SELECT e.wallet, e.tick_lower, e.tick_upper, e.depth, e.n AS pair_number, x.s0 - x.m0 AS candidate_count, e.log_index AS entry_log_index, x.log_index AS exit_log_index, e.order_key AS entry_order_key, x.order_key AS exit_order_key,
         e.sec AS entry_sec, x.sec AS exit_sec, e.cents AS entry_cents, x.cents AS exit_cents, e.transaction_index AS entry_transaction_index, x.transaction_index AS exit_transaction_index, e.block_number AS entry_block_number, x.block_number AS exit_block_number,
         e.base_position AS entry_base_position, x.base_position AS exit_base_position, 10.0 * (e.tick_upper / 100)::DOUBLE AS low, 60.0 * (e.tick_upper / 100)::DOUBLE AS high, e.depth::DOUBLE AS liquidity
  FROM matched e JOIN matched x ON e.wallet = x.wallet AND e.tick_lower = x.tick_lower AND e.tick_upper = x.tick_upper AND e.depth = x.depth AND e.n = x.n AND e.opens AND NOT x.opens AND e.is_matched AND x.is_matched),
swaps AS (SELECT order_key, block_number, sec, price, cents FROM l WHERE kind = 'Swap')"""
