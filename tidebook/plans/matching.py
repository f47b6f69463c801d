"""Queries of decoding, matching, fees and life cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import abi
from tidebook.operators.fees import attribute_collections
from tidebook.operators.lifecycle import balance_table, daily_activity
from tidebook.operators.matching import depth_mismatches, nearest_links, overlapping
from tidebook.operators.statistics import shares
from tidebook.plans.ledger import BASE, KEY, MATCH_WIDTH, L, M, ledger, matched, operations, pairs

PAIR = ["wallet", "tick_lower", "tick_upper", "depth", "pair_number"]


def ledger_events(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).orderBy("order_key")


def event_type_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(ledger(spark, d), ["kind"], "event_type")


def abi_words(spark: SparkSession, d: str) -> DataFrame:
    """Logs are encoded as a contract would and decoded again."""
    word = lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), 64, "0")
    negative = lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), 64, "f")
    rows = ledger(spark, d)
    topics = F.to_json(F.array(F.lit("0x" + "ab" * 32), F.concat(F.lit("0x"), word(F.col("wallet"))), F.concat(F.lit("0x"), negative(F.col("tick_lower")))))
    data = F.concat(F.lit("0x"), word(F.col("cents")), negative(-F.col("cents") - 1), word(F.col("depth")), F.rpad(F.lit("1"), 64, "0"))
    raw = rows.select("log_index", topics.alias("topics"), data.alias("data")).withColumn("w", abi.words(F.col("data")))
    w = lambda i: F.get("w", F.lit(i))
    return raw.select("log_index", abi.integer_word(w(0)).alias("amount0"), abi.integer_word(w(1), True).alias("amount1"), abi.small_signed(w(2)).alias("depth"), abi.integer_word(w(3)).alias("wide"), abi.small_signed(abi.topic_word(F.col("topics"), F.lit(2))).alias("tick_lower"), abi.address_word(abi.topic_word(F.col("topics"), F.lit(1))).alias("owner"))


def operation_ids(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    entry, exit_ = (abi.event_id(F.concat(F.lit("0x"), F.col(f"{s}_block_number")), F.col(f"{s}_log_index")) for s in ("entry", "exit"))
    return p.select(abi.operation_id(entry, exit_).alias("operation_id"), "wallet")


def fifo_position_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select(*PAIR, "candidate_count", "entry_log_index", "exit_log_index")


def unmatched_reasons(spark: SparkSession, d: str) -> DataFrame:
    zero = ledger(spark, d).filter("kind IN ('Mint', 'Burn') AND depth = 0").select("kind", F.lit("zero_liquidity").alias("reason"))
    rest = matched(spark, d).filter("NOT is_matched").select(F.when(F.col("opens"), "Mint").otherwise("Burn").alias("kind"), F.col("unmatched_reason").alias("reason"))
    return zero.unionByName(rest).groupBy("kind", "reason").agg(F.count("*").alias("n"))


def pair_waterfall(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by the first rule that sets them apart."""
    first = F.when(F.col("candidate_count") > 1, "ambiguous").when(F.col("exit_base_position") - F.col("entry_base_position") > 1, "intervening_event").when((F.col("entry_block_number") == F.col("exit_block_number")) & (F.col("entry_transaction_index") == F.col("exit_transaction_index")), "same_transaction").when(F.col("exit_sec") <= F.col("entry_sec"), "no_holding_time").otherwise("strict")
    return pairs(spark, d).groupBy(first.alias("rule")).agg(F.count("*").alias("n"))


def depth_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = matched(spark, d).filter("NOT is_matched")
    return depth_mismatches(rows, BASE, "opens", "depth").select("log_index", "opens", "depth")


def nearest_position_links(spark: SparkSession, d: str) -> DataFrame:
    return nearest_links(operations(spark, d), KEY, ["order_key"], "opens", "log_index", MATCH_WIDTH).select("open_log_index", "close_log_index")


def overlapping_pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlapping(pairs(spark, d), BASE, "entry_order_key", "exit_order_key", ["exit_order_key", "depth"], MATCH_WIDTH).select(*PAIR)


def realized_fees(spark: SparkSession, d: str) -> DataFrame:
    """Fees of each pair from the collections of its wallet and range; the exit's are those of its transaction."""
    rows = ledger(spark, d)
    collects = rows.filter("kind = 'Collect'").select(*BASE, "order_key", "cents")
    place = {"exit_block_number": "block_number", "exit_transaction_index": "transaction_index"}
    scopes = rows.groupBy(*[F.col(c).alias(n) for n, c in place.items()]).agg(F.min("order_key").alias("scope_first"), F.max("order_key").alias("scope_last"))
    p = pairs(spark, d).join(scopes, list(place))
    out = attribute_collections(p, PAIR, collects, BASE, "entry_order_key", "exit_order_key", ("scope_first", "scope_last"), "order_key", ["cents"], ["exit_cents"], MATCH_WIDTH)
    return out.select(*PAIR, "interim_count", "exit_count", "exit_covers_principal", F.col("fee_cents").cast("bigint").alias("realized_fee"))


def position_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return balance_table(ledger(spark, d).filter("kind <> 'Swap'"), BASE)


def pool_daily(spark: SparkSession, d: str) -> DataFrame:
    return daily_activity(ledger(spark, d))


QUERIES = {f.__name__: f for f in (ledger_events, event_type_shares, abi_words, operation_ids, fifo_position_pairs, unmatched_reasons, pair_waterfall, depth_mismatch, nearest_position_links, overlapping_pairs, realized_fees, position_lifecycle, pool_daily)}

_SAME = "a.wallet = b.wallet AND a.tick_lower = b.tick_lower AND a.tick_upper = b.tick_upper"
SQL = {
    "ledger_events": f"WITH {L} SELECT * FROM l",
    "event_type_shares": f"WITH {L} SELECT kind, event_type, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY kind)::DOUBLE AS share_pct FROM l GROUP BY kind, event_type",
    "abi_words": f"WITH {L} SELECT log_index, cents::VARCHAR AS amount0, (-cents - 1)::VARCHAR AS amount1, depth, '{16**63}' AS wide, tick_lower, '0x' || lpad(lower(hex(wallet)), 40, '0') AS owner FROM l",
    "operation_ids": f"WITH {M} SELECT sha256('0x' || entry_block_number || ':' || entry_log_index || '|0x' || exit_block_number || ':' || exit_log_index) AS operation_id, wallet FROM pairs",
    "fifo_position_pairs": f"WITH {M} SELECT wallet, tick_lower, tick_upper, depth, pair_number, candidate_count, entry_log_index, exit_log_index FROM pairs",
    "unmatched_reasons": f"WITH {M} SELECT kind, CASE WHEN opens THEN 'no_subsequent_close' ELSE 'no_preceding_open' END AS reason, count(*) AS n FROM matched WHERE NOT is_matched GROUP BY ALL UNION ALL SELECT kind, 'zero_liquidity', count(*) FROM l WHERE kind IN ('Mint', 'Burn') AND depth = 0 GROUP BY kind",
    "pair_waterfall": f"WITH {M} SELECT CASE WHEN candidate_count > 1 THEN 'ambiguous' WHEN exit_base_position - entry_base_position > 1 THEN 'intervening_event' WHEN entry_block_number = exit_block_number AND entry_transaction_index = exit_transaction_index THEN 'same_transaction' WHEN exit_sec <= entry_sec THEN 'no_holding_time' ELSE 'strict' END AS rule, count(*) AS n FROM pairs GROUP BY 1",
    "depth_mismatch": f"WITH {M}, u AS (SELECT * FROM matched WHERE NOT is_matched) SELECT log_index, opens, depth FROM u a WHERE EXISTS (SELECT 1 FROM u b WHERE {_SAME} AND a.opens <> b.opens AND a.depth <> b.depth)",
    "nearest_position_links": f"WITH {M}, levels AS (SELECT *, CASE WHEN opens THEN s - m ELSE s0 - m0 END AS level FROM hit WHERE opens OR closed) SELECT (SELECT max(o.log_index) FROM levels o WHERE o.opens AND o.wallet = c.wallet AND o.tick_lower = c.tick_lower AND o.depth = c.depth AND o.level = c.level AND o.order_key < c.order_key AND o.order_key = (SELECT max(q.order_key) FROM levels q WHERE q.opens AND q.wallet = c.wallet AND q.tick_lower = c.tick_lower AND q.depth = c.depth AND q.level = c.level AND q.order_key < c.order_key)) AS open_log_index, log_index AS close_log_index FROM levels c WHERE closed",
    "overlapping_pairs": f"WITH {M} SELECT wallet, tick_lower, tick_upper, depth, pair_number FROM pairs a WHERE EXISTS (SELECT 1 FROM pairs b WHERE {_SAME} AND (a.depth, a.pair_number) <> (b.depth, b.pair_number) AND a.entry_order_key < b.exit_order_key AND b.entry_order_key < a.exit_order_key)",
    "realized_fees": f"""WITH {M},
hits AS (
  SELECT a.wallet, a.tick_lower, a.tick_upper, a.depth, a.pair_number, a.exit_cents, b.block_number = a.exit_block_number AND b.transaction_index = a.exit_transaction_index AS at_exit, b.cents
  FROM pairs a LEFT JOIN l b ON {_SAME} AND b.kind = 'Collect' AND ((b.order_key > a.entry_order_key AND (b.block_number, b.transaction_index) < (a.exit_block_number, a.exit_transaction_index))
    OR (b.block_number = a.exit_block_number AND b.transaction_index = a.exit_transaction_index AND b.log_index > a.exit_log_index)))
SELECT wallet, tick_lower, tick_upper, depth, pair_number, count(cents) FILTER (WHERE NOT at_exit) AS interim_count, count(cents) FILTER (WHERE at_exit) AS exit_count,
  coalesce(sum(cents) FILTER (WHERE at_exit), 0) >= any_value(exit_cents) AS exit_covers_principal,
  coalesce(sum(cents) FILTER (WHERE NOT at_exit), 0)::BIGINT + greatest(coalesce(sum(cents) FILTER (WHERE at_exit), 0) - any_value(exit_cents), 0)::BIGINT AS realized_fee
FROM hits GROUP BY wallet, tick_lower, tick_upper, depth, pair_number""",
    "position_lifecycle": f"""WITH {L} SELECT wallet, tick_lower, tick_upper, count(*) FILTER (WHERE kind = 'Mint') AS mint_count, count(*) FILTER (WHERE kind = 'Burn') AS burn_count, count(*) FILTER (WHERE kind = 'Collect') AS collect_count,
  coalesce(sum(depth) FILTER (WHERE kind = 'Mint'), 0)::BIGINT AS liquidity_in, coalesce(sum(depth) FILTER (WHERE kind = 'Burn'), 0)::BIGINT AS liquidity_out, coalesce(sum(cents) FILTER (WHERE kind = 'Mint'), 0)::BIGINT AS deposited, coalesce(sum(cents) FILTER (WHERE kind = 'Burn'), 0)::BIGINT AS withdrawn, coalesce(sum(cents) FILTER (WHERE kind = 'Collect'), 0)::BIGINT AS collected,
  min(order_key) FILTER (WHERE kind = 'Mint') AS first_mint_key, max(order_key) FILTER (WHERE kind = 'Burn') AS last_burn_key, arg_min(log_index, order_key) AS first_log_index, arg_max(log_index, order_key) AS last_log_index, count(DISTINCT depth) AS depths
FROM l WHERE kind <> 'Swap' GROUP BY wallet, tick_lower, tick_upper""",
    "pool_daily": f"""WITH {L} SELECT sec // 86400 AS day_number, count(*) FILTER (WHERE kind = 'Swap') AS swap_count, count(*) FILTER (WHERE kind = 'Mint') AS mint_count, count(*) FILTER (WHERE kind = 'Burn') AS burn_count, count(*) FILTER (WHERE kind = 'Collect') AS collect_count,
  coalesce(sum(cents) FILTER (WHERE kind = 'Swap'), 0)::BIGINT AS swap_cents, coalesce(sum(cents) FILTER (WHERE kind = 'Mint'), 0)::BIGINT AS mint_cents, coalesce(sum(cents) FILTER (WHERE kind = 'Burn'), 0)::BIGINT AS burn_cents, coalesce(sum(cents) FILTER (WHERE kind = 'Collect'), 0)::BIGINT AS collect_cents,
  min(sec) FILTER (WHERE kind = 'Swap') AS first_swap_sec, max(sec) FILTER (WHERE kind = 'Swap') AS last_swap_sec, arg_min(price, order_key) FILTER (WHERE kind = 'Swap') AS open_price, arg_max(price, order_key) FILTER (WHERE kind = 'Swap') AS close_price
FROM l GROUP BY 1""",
}
