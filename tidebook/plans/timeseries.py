"""Queries of densification, as-of lookups, interval joins and ordered windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.operators.densify import coverage_faults, dense_days, dense_grid, gap_runs, last_by_bin, week_ending_sunday
from tidebook.operators import ordered
from tidebook.operators.ordered import asof_join, block_ends, interval_extremes, keep_last, running_sums, top_per_cell
from tidebook.plans.ledger import KEY_WIDTH, SECONDS_WIDTH, L, M, ledger, pairs, swaps
from tidebook.util import table

PAIR = ["wallet", "tick_lower", "tick_upper", "depth", "pair_number"]
STEP = 60


def minute_grid(spark: SparkSession, d: str) -> DataFrame:
    """Trades on a dense grid of minutes."""
    return dense_grid(swaps(spark, d), "sec", "price", "cents", STEP, SECONDS_WIDTH)


def minute_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Runs of minutes without a trade."""
    return gap_runs(minute_grid(spark, d).filter("is_imputed"), "sec", STEP, width=SECONDS_WIDTH)


def second_grid(spark: SparkSession, d: str) -> DataFrame:
    """Trades on a dense grid of seconds; of a second's trades the last in order gives the price."""
    return dense_grid(swaps(spark, d), "sec", "price", "cents", 1, SECONDS_WIDTH, tie="order_key")


def second_grid_hours(spark: SparkSession, d: str) -> DataFrame:
    """The grid of seconds by hour: points, points without a trade, amounts, and the sum and last of the carried prices."""
    hours = second_grid(spark, d).groupBy(F.expr("sec div 3600").alias("hour"))
    price = F.round(F.col("price") * 10_000).cast("bigint")
    return hours.agg(F.count("*").alias("points"), F.count_if("is_imputed").alias("imputed"), F.sum("cents").alias("cents"), F.sum(price).alias("price_sum"), F.max_by(price, "sec").alias("last_price"))


def second_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Runs of seconds without a trade."""
    return gap_runs(second_grid(spark, d).filter("is_imputed"), "sec", 1, width=SECONDS_WIDTH)


def price_10min(spark: SparkSession, d: str) -> DataFrame:
    return last_by_bin(swaps(spark, d), "sec", "price", 600)


def _daily_close(spark: SparkSession, d: str) -> DataFrame:
    bins = last_by_bin(swaps(spark, d), "sec", "price", 86_400)
    return bins.select(F.date_add(F.lit("1970-01-01").cast("date"), (F.col("bin_start") / 86_400).cast("int")).alias("day"), "price")


def calendar_ffill(spark: SparkSession, d: str) -> DataFrame:
    """Daily values known on some days only, carried to every day of the calendar."""
    known = _daily_close(spark, d).filter("price > 20")
    return dense_days(known, "day", ["price"]).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "price")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), "o_custkey", "o_orderstatus", "o_orderkey", "o_orderpriority")


def weekly_resample(spark: SparkSession, d: str) -> DataFrame:
    weeks = _orders(spark, d).groupBy(week_ending_sunday("day").alias("week"))
    return weeks.agg(F.sum("cents").alias("cents"), F.count("*").alias("n"), F.avg("cents").alias("mean_cents")).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


def month_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Months without rows have a count of 0 and null amounts."""
    urgent = _orders(spark, d).filter("o_orderstatus = 'P' AND cents > 45000000")
    months = urgent.groupBy(F.date_trunc("month", "day").cast("date").alias("month")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    every = months.agg(F.min("month").alias("a"), F.max("month").alias("z")).select(F.explode(F.expr("sequence(a, z, interval 1 month)")).alias("month"))
    return every.join(months, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"), "cents")


def partition_faults(spark: SparkSession, d: str) -> DataFrame:
    """Days of trades as partitions: those that overlap the one before or leave a hole of over ten minutes."""
    parts = swaps(spark, d).groupBy(F.expr("sec div 86400").alias("day_number")).agg(F.min("sec").alias("first"), F.max("sec").alias("last"))
    return coverage_faults(parts, "day_number", "first", "last", 600)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).filter("kind <> 'Swap'").select("log_index", "sec", "order_key", "cents")


def asof_strict(spark: SparkSession, d: str) -> DataFrame:
    """The last trade price strictly before each event's second."""
    return asof_join(_events(spark, d), swaps(spark, d), "sec", "sec", ["price"], SECONDS_WIDTH, tie="order_key").select("log_index", "price", "sec_matched")


def asof_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return asof_join(_events(spark, d), swaps(spark, d), "sec", "sec", ["price"], SECONDS_WIDTH, tolerance=300, tie="order_key").select("log_index", "price", "sec_matched")


def asof_by_source(spark: SparkSession, d: str) -> DataFrame:
    """For each reading of a feed, the feed's last reading of more volume than 1000 at or before it."""
    rows = table(spark, d, "oracle").select("feed_id", F.unix_micros("timestamp").alias("t"), "price", "volume")
    rows = rows.filter("price > 0 AND price < 1e12").groupBy("feed_id", "t").agg(F.max("price").alias("price"), F.max("volume").alias("volume"))
    big = rows.filter("volume > 1000").select("feed_id", "t", F.col("price").alias("big_price"))
    return asof_join(rows.select("feed_id", "t", "price"), big, "t", "t", ["big_price"], 3_600_000_000, by=["feed_id"], strict=False)


def exact_prior(spark: SparkSession, d: str) -> DataFrame:
    """The grid price of the second before each event's; null before the first trade and after the last."""
    return ordered.exact_prior(_events(spark, d), second_grid(spark, d), "sec", "sec", ["price"], required=False).select("log_index", "sec", "price")


def state_before(spark: SparkSession, d: str) -> DataFrame:
    """The pool price before each event in event order; before the first trade the initial price of 50."""
    found = asof_join(_events(spark, d), swaps(spark, d).withColumnRenamed("order_key", "k"), "order_key", "k", ["price"], KEY_WIDTH)
    return found.select("log_index", F.coalesce("price", F.lit(50.0)).alias("price"))


def interval_trade_sums(spark: SparkSession, d: str) -> DataFrame:
    """Trades between entry and exit of each pair, as differences of running sums: no pair meets its trades."""
    run = running_sums(swaps(spark, d), "order_key", [], {"n": F.lit(1), "total": F.col("cents")}, KEY_WIDTH).select(F.col("order_key").alias("k"), "n", "total")
    p = pairs(spark, d).select(*PAIR, "entry_order_key", "exit_order_key")
    for side in ("entry", "exit"):
        p = asof_join(p, run, f"{side}_order_key", "k", ["n", "total"], KEY_WIDTH).withColumnsRenamed({"n": f"n_{side}", "total": f"total_{side}"}).drop("k_matched")
    zero = F.lit(0).cast("bigint")
    return p.select(*PAIR, (F.coalesce("n_exit", zero) - F.coalesce("n_entry", zero)).alias("trades"), (F.coalesce("total_exit", zero) - F.coalesce("total_entry", zero)).alias("cents"))


def interval_trade_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The same trades' extremes and those within the pair's range, from blocks of numbered trades; no pair meets its trades."""
    p = pairs(spark, d).select(*PAIR, "entry_order_key", "exit_order_key", "low", "high")
    return interval_extremes(p, PAIR, swaps(spark, d).select("order_key", "price"), "entry_order_key", "exit_order_key", "order_key", "price", "low", "high", KEY_WIDTH)


def block_endpoints(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(spark, d).filter("kind = 'Swap'")
    return rows.select("log_index", "block_number", "wallet", block_ends(rows, ["wallet"], "block_number", ["order_key"]).alias("is_block_end"))


def open_position_curve(spark: SparkSession, d: str) -> DataFrame:
    """Open positions and depth at the end of each day, and the day's peak, counting the state it began with."""
    moves = ledger(spark, d).filter("kind IN ('Mint', 'Burn')").withColumn("d", F.when(F.col("kind") == "Mint", 1).otherwise(-1))
    run = running_sums(moves, "order_key", [], {"open": F.col("d"), "open_depth": F.col("d") * F.col("depth")}, KEY_WIDTH)
    days = run.groupBy(F.expr("sec div 86400").alias("day_number")).agg(F.max_by("open", "order_key").alias("open_end"), F.max_by("open_depth", "order_key").alias("depth_end"), F.max("open").alias("__peak"))
    before = F.lag("open_end").over(Window.orderBy("day_number"))
    return days.select("day_number", "open_end", "depth_end", F.greatest("__peak", before).alias("open_peak"))


def rolling_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of 30 rows and of 30 days, sample deviation of 30 rows, difference and shift of daily closes."""
    w = Window.orderBy("day")
    rows, days = w.rowsBetween(-29, 0), Window.orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-29, 0)
    close = _daily_close(spark, d)
    return close.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.avg("price").over(rows), 8).alias("mean_rows"), F.when(F.count("price").over(days) >= 7, F.round(F.avg("price").over(days), 8)).alias("mean_days"), F.when(F.count("price").over(rows) >= 30, F.round(F.stddev_samp("price").over(rows), 8)).alias("std_rows"), F.round(F.col("price") - F.lag("price").over(w), 8).alias("change"), F.lag("price").over(w).alias("previous"))


def volatility(spark: SparkSession, d: str) -> DataFrame:
    """Yearly volatility from the last 30 daily log returns, and realized volatility of each day from 10-minute prices."""
    w = Window.orderBy("day")
    daily = _daily_close(spark, d).withColumn("r", F.log(F.col("price") / F.lag("price").over(w)))
    historic = daily.select("day", F.when(F.count("r").over(w.rowsBetween(-29, 0)) >= 30, F.stddev_samp("r").over(w.rowsBetween(-29, 0)) * F.sqrt(F.lit(365.0))).alias("historic"))
    # the first bin of a stretch looks back into the one before, so returns are joined on the bin's number
    bins = price_10min(spark, d).select(F.expr("bin_start div 600").alias("b"), "price")
    returns = bins.alias("x").join(bins.select((F.col("b") + 1).alias("b"), F.col("price").alias("before")), "b").withColumn("r2", F.pow(F.log(F.col("price") / F.col("before")), 2))
    realized = returns.groupBy(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("b") / 144).cast("int")).alias("day")).agg((F.sqrt(F.sum("r2")) * F.sqrt(F.lit(365.0))).alias("realized"))
    return historic.join(realized, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("historic", 8).alias("historic"), F.round("realized", 8).alias("realized"))


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """One reading of each feed and instant: the one that came last."""
    rows = table(spark, d, "oracle").select("feed_id", F.unix_micros("timestamp").alias("t"), F.unix_micros("ingested_at").alias("version"), F.when(~F.isnan("price"), F.col("price")).alias("price"))
    return keep_last(rows, ["feed_id", "t"], ["version"])


def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The largest order of each status and priority, ties to the smaller key."""
    return top_per_cell(_orders(spark, d), ["o_orderstatus", "o_orderpriority"], [F.desc("cents"), F.asc("o_orderkey")]).select("o_orderstatus", "o_orderpriority", "o_orderkey", "cents")


def aligned_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows of several kinds in one table, missing columns null, sorted by time, kind and order with nulls last."""
    p = pairs(spark, d)
    parts = [p.select(*PAIR, F.col("entry_sec").alias("sec"), F.lit("entry").alias("row_kind"), F.col("entry_order_key").alias("order_key")), p.select(*PAIR, F.col("exit_sec").alias("sec"), F.lit("exit").alias("row_kind"), F.col("exit_order_key").alias("order_key")), p.filter("entry_sec < exit_sec").select(*PAIR, F.expr("(entry_sec + exit_sec) div 2").alias("sec"), F.lit("middle").alias("row_kind"))]
    rank = F.when(F.col("row_kind") == "entry", 0).when(F.col("row_kind") == "middle", 1).otherwise(2)
    union = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    return union.orderBy("sec", rank, F.asc_nulls_last("order_key"), *PAIR)


QUERIES = {f.__name__: f for f in (minute_grid, minute_gaps, second_grid_hours, second_gaps, price_10min, calendar_ffill, weekly_resample, month_calendar, partition_faults, asof_strict, asof_tolerance, asof_by_source, exact_prior, state_before, interval_trade_sums, interval_trade_extremes, block_endpoints, open_position_curve, rolling_means, volatility, latest_version, top_per_group, aligned_union)}

_EV = L + ", ev AS (SELECT * FROM l WHERE kind <> 'Swap'), sw AS (SELECT order_key, sec, price, cents FROM l WHERE kind = 'Swap'), lasts AS (SELECT sec, arg_max(price, order_key) AS price FROM sw GROUP BY sec)"
_GRID = L + """, cells AS (SELECT sec // 60 * 60 AS sec, arg_max(price, (sec, price)) AS price, sum(cents)::BIGINT AS cents FROM l WHERE kind = 'Swap' GROUP BY 1),
grid AS (SELECT unnest(generate_series((SELECT min(sec) FROM cells), (SELECT max(sec) FROM cells), 60)) AS sec),
minutes AS (SELECT g.sec, last_value(c.price IGNORE NULLS) OVER (ORDER BY g.sec) AS price, coalesce(c.cents, 0) AS cents, c.price IS NULL AS is_imputed FROM grid g LEFT JOIN cells c USING (sec))"""
_SECONDS = L + """, ticks AS (SELECT sec, arg_max(price, order_key) AS price, sum(cents)::BIGINT AS cents FROM l WHERE kind = 'Swap' GROUP BY 1),
points AS (SELECT unnest(generate_series((SELECT min(sec) FROM ticks), (SELECT max(sec) FROM ticks))) AS sec),
seconds AS (SELECT p.sec, last_value(c.price IGNORE NULLS) OVER (ORDER BY p.sec) AS price, coalesce(c.cents, 0) AS cents, c.price IS NULL AS is_imputed FROM points p LEFT JOIN ticks c USING (sec))"""
_CLOSE = L + ", close AS (SELECT DATE '1970-01-01' + (sec // 86400)::INT AS day, arg_max(price, (sec, price)) AS price FROM l WHERE kind = 'Swap' GROUP BY 1)"
_ORDERS = "o AS (SELECT o_orderdate::DATE AS day, round(o_totalprice * 100)::BIGINT AS cents, * FROM orders)"
SQL = {
    "minute_grid": f"WITH {_GRID} SELECT * FROM minutes",
    "minute_gaps": f"WITH {_GRID}, m AS (SELECT sec, sec - 60 * row_number() OVER (ORDER BY sec) AS island FROM minutes WHERE is_imputed) SELECT min(sec) AS gap_start, max(sec) AS gap_end, count(*) AS points FROM m GROUP BY island",
    "second_grid_hours": f"WITH {_SECONDS} SELECT sec // 3600 AS hour, count(*) AS points, count(*) FILTER (WHERE is_imputed) AS imputed, sum(cents)::BIGINT AS cents, sum(round(price * 10000)::BIGINT)::BIGINT AS price_sum, arg_max(round(price * 10000)::BIGINT, sec) AS last_price FROM seconds GROUP BY 1",
    "second_gaps": f"WITH {_SECONDS}, m AS (SELECT sec, sec - row_number() OVER (ORDER BY sec) AS island FROM seconds WHERE is_imputed) SELECT min(sec) AS gap_start, max(sec) AS gap_end, count(*) AS points FROM m GROUP BY island",
    "price_10min": f"WITH {L} SELECT sec // 600 * 600 AS bin_start, arg_max(price, (sec, price)) AS price FROM l WHERE kind = 'Swap' GROUP BY 1",
    "calendar_ffill": f"WITH {_CLOSE}, k AS (SELECT * FROM close WHERE price > 20), c AS (SELECT unnest(generate_series((SELECT min(day) FROM k)::TIMESTAMP, (SELECT max(day) FROM k)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day) SELECT strftime(c.day, '%Y-%m-%d') AS day, last_value(k.price IGNORE NULLS) OVER (ORDER BY c.day) AS price FROM c LEFT JOIN k ON k.day = c.day",
    "weekly_resample": f"WITH {_ORDERS} SELECT strftime(date_trunc('week', day)::DATE + 6, '%Y-%m-%d') AS week, sum(cents)::BIGINT AS cents, count(*) AS n, avg(cents) AS mean_cents FROM o GROUP BY 1",
    "month_calendar": f"WITH {_ORDERS}, m AS (SELECT date_trunc('month', day)::DATE AS month, count(*) AS n, sum(cents)::BIGINT AS cents FROM o WHERE o_orderstatus = 'P' AND cents > 45000000 GROUP BY 1), c AS (SELECT unnest(generate_series((SELECT min(month) FROM m)::TIMESTAMP, (SELECT max(month) FROM m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month) SELECT strftime(c.month, '%Y-%m') AS month, coalesce(n, 0) AS n, cents FROM c LEFT JOIN m ON m.month = c.month",
    "partition_faults": f"WITH {L}, p AS (SELECT sec // 86400 AS day_number, min(sec) AS first, max(sec) AS last FROM l WHERE kind = 'Swap' GROUP BY 1), j AS (SELECT *, first - lag(last) OVER (ORDER BY day_number) AS size FROM p) SELECT day_number, CASE WHEN last < first THEN 'reversed' WHEN size <= 0 THEN 'overlap' ELSE 'hole' END AS fault, size FROM j WHERE last < first OR size <= 0 OR size > 600",
    "asof_strict": f"WITH {_EV} SELECT log_index, p.price, p.sec AS sec_matched FROM ev ASOF LEFT JOIN lasts p ON ev.sec > p.sec",
    "asof_tolerance": f"WITH {_EV} SELECT log_index, CASE WHEN ev.sec - p.sec <= 300 THEN p.price END AS price, CASE WHEN ev.sec - p.sec <= 300 THEN p.sec END AS sec_matched FROM ev ASOF LEFT JOIN lasts p ON ev.sec > p.sec",
    "asof_by_source": "WITH r AS (SELECT feed_id, epoch_us(timestamp) AS t, max(price) AS price, max(volume) AS volume FROM oracle WHERE isfinite(price) AND price > 0 GROUP BY 1, 2) SELECT r.feed_id, r.t, r.price, b.price AS big_price, b.t AS t_matched FROM r ASOF LEFT JOIN (SELECT * FROM r WHERE volume > 1000) b ON r.feed_id = b.feed_id AND r.t >= b.t",
    "exact_prior": f"WITH {_SECONDS} SELECT log_index, l.sec, g.price FROM l LEFT JOIN seconds g ON g.sec = l.sec - 1 WHERE kind <> 'Swap'",
    "state_before": f"WITH {_EV} SELECT log_index, coalesce(sw.price, 50.0) AS price FROM ev ASOF LEFT JOIN sw ON ev.order_key > sw.order_key",
    "interval_trade_sums": f"WITH {M} SELECT wallet, tick_lower, tick_upper, depth, pair_number, count(s.order_key) AS trades, coalesce(sum(s.cents), 0)::BIGINT AS cents FROM pairs p LEFT JOIN swaps s ON s.order_key > p.entry_order_key AND s.order_key < p.exit_order_key GROUP BY wallet, tick_lower, tick_upper, depth, pair_number",
    "interval_trade_extremes": f"WITH {M} SELECT wallet, tick_lower, tick_upper, depth, pair_number, count(*) AS trades, max(price) AS highest, min(price) AS lowest, count(*) FILTER (WHERE price BETWEEN low AND high) AS in_range FROM pairs p JOIN swaps s ON s.order_key > p.entry_order_key AND s.order_key < p.exit_order_key GROUP BY wallet, tick_lower, tick_upper, depth, pair_number",
    "block_endpoints": f"WITH {L} SELECT log_index, block_number, wallet, row_number() OVER (PARTITION BY wallet, block_number ORDER BY order_key DESC) = 1 AS is_block_end FROM l WHERE kind = 'Swap'",
    "open_position_curve": f"WITH {L}, r AS (SELECT sec // 86400 AS day_number, order_key, sum(CASE kind WHEN 'Mint' THEN 1 ELSE -1 END) OVER (ORDER BY order_key) AS open, sum(CASE kind WHEN 'Mint' THEN depth ELSE -depth END) OVER (ORDER BY order_key) AS open_depth FROM l WHERE kind IN ('Mint', 'Burn')), g AS (SELECT day_number, arg_max(open, order_key)::BIGINT AS open_end, arg_max(open_depth, order_key)::BIGINT AS depth_end, max(open)::BIGINT AS peak FROM r GROUP BY 1) SELECT day_number, open_end, depth_end, greatest(peak, coalesce(lag(open_end) OVER (ORDER BY day_number), peak)) AS open_peak FROM g",
    "rolling_means": f"WITH {_CLOSE} SELECT strftime(day, '%Y-%m-%d') AS day, round(avg(price) OVER r, 8) AS mean_rows, CASE WHEN count(*) OVER t >= 7 THEN round(avg(price) OVER t, 8) END AS mean_days, CASE WHEN count(*) OVER r >= 30 THEN round(stddev_samp(price) OVER r, 8) END AS std_rows, round(price - lag(price) OVER w, 8) AS change, lag(price) OVER w AS previous FROM close WINDOW w AS (ORDER BY day), r AS (ORDER BY day ROWS 29 PRECEDING), t AS (ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)",
    "volatility": f"WITH {_CLOSE}, r AS (SELECT day, ln(price / lag(price) OVER (ORDER BY day)) AS r FROM close), h AS (SELECT day, CASE WHEN count(r) OVER w >= 30 THEN stddev_samp(r) OVER w * sqrt(365.0) END AS historic FROM r WINDOW w AS (ORDER BY day ROWS 29 PRECEDING)), b AS (SELECT sec // 600 AS b, arg_max(price, (sec, price)) AS price FROM l WHERE kind = 'Swap' GROUP BY 1), v AS (SELECT DATE '1970-01-01' + (x.b // 144)::INT AS day, sqrt(sum(pow(ln(x.price / y.price), 2))) * sqrt(365.0) AS realized FROM b x JOIN b y ON x.b = y.b + 1 GROUP BY 1) SELECT strftime(h.day, '%Y-%m-%d') AS day, round(historic, 8) AS historic, round(realized, 8) AS realized FROM h LEFT JOIN v USING (day)",
    "latest_version": "SELECT feed_id, epoch_us(timestamp) AS t, epoch_us(ingested_at) AS version, CASE WHEN NOT isnan(price) THEN price END AS price FROM oracle QUALIFY row_number() OVER (PARTITION BY feed_id, timestamp ORDER BY ingested_at DESC, CASE WHEN NOT isnan(price) THEN price END DESC NULLS LAST) = 1",
    "top_per_group": f"WITH {_ORDERS} SELECT o_orderstatus, o_orderpriority, o_orderkey, cents FROM o QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY cents DESC, o_orderkey) = 1",
    "aligned_union": f"WITH {M} SELECT wallet, tick_lower, tick_upper, depth, pair_number, entry_sec AS sec, 'entry' AS row_kind, entry_order_key AS order_key FROM pairs UNION ALL SELECT wallet, tick_lower, tick_upper, depth, pair_number, exit_sec, 'exit', exit_order_key FROM pairs UNION ALL SELECT wallet, tick_lower, tick_upper, depth, pair_number, (entry_sec + exit_sec) // 2, 'middle', NULL FROM pairs WHERE entry_sec < exit_sec",
}
