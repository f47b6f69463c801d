"""Queries of joins for audit, descriptive statistics, cohorts and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.operators.quality import count_violations, repeated_keys, together, unmatched
from tidebook.operators.statistics import describe, finite, inconsistent, simple_regression, spearman, value_ranks
from tidebook.plans.ledger import L, M, ledger, pairs
from tidebook.plans.timeseries import PAIR
from tidebook.util import hex_text, table


def sender_audit(spark: SparkSession, d: str) -> DataFrame:
    """Orders joined many to one with their customers: rows, rows without a customer, and customers listed twice."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    twice = repeated_keys(customers, ["c_custkey"], "x").select(F.col("violations").alias("repeated"))
    counts = joined.agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey").isNull()).alias("orphans"), F.count_distinct("c_custkey").alias("senders"))
    return counts.join(F.broadcast(twice), F.lit(True))  # one row each


def one_to_one_audit(spark: SparkSession, d: str) -> DataFrame:
    """Metrics against their pairs: how many ids are on one side or both, and how many disagree on the pool."""
    left = table(spark, d, "operation_pairs").groupBy(hex_text("operation_id").alias("id")).agg(F.max(hex_text("pool_address")).alias("pool_a"))
    right = table(spark, d, "position_metrics").groupBy(hex_text("operation_id").alias("id")).agg(F.max(hex_text("pool_address")).alias("pool_b"))
    both = left.withColumn("a", F.lit(1)).join(right.withColumn("b", F.lit(1)), "id", "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("pool_a") != F.col("pool_b")).alias("disagree"))


def linked_events(spark: SparkSession, d: str) -> DataFrame:
    """Collections of wallets and ranges that some pair has (semi-join)."""
    keys = ["wallet", "tick_lower", "tick_upper"]
    return ledger(spark, d).filter("kind = 'Collect'").join(pairs(spark, d).select(*keys), keys, "left_semi").select("log_index", *keys)


def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    """Set difference as an anti-join."""
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


def scalar_row(spark: SparkSession, d: str) -> DataFrame:
    """One-row aggregates side by side: the newest block below the finality cut and the newest of all."""
    rows = ledger(spark, d)
    newest = rows.agg(F.max("block_number").alias("latest_block"))
    last = rows.join(F.broadcast(newest), F.lit(True)).filter(F.col("block_number") <= F.col("latest_block") - 64)
    return last.groupBy("latest_block").agg(F.max_by(F.struct("block_number", "order_key", "log_index"), "order_key").alias("b")).select("latest_block", F.col("b.block_number").alias("final_block"), F.col("b.log_index").alias("final_log_index"))


def rate_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each day's rate of a daily table joined to the orders of that day."""
    days = table(spark, d, "portfolio_daily").groupBy("date").agg(F.max("sofr_percent").alias("percent"))
    events = ledger(spark, d).groupBy(F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(sec div 86400 as int)")).alias("date")).agg(F.count("*").alias("n"))
    return events.join(days, "date", "left").select(F.date_format("date", "yyyy-MM-dd").alias("date"), "n", "percent")


def block_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily count, range, exact mean and median, and mean ratio where the denominator is above 0."""
    rows = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), "l_orderkey", "l_discount", "l_tax")
    ratio = F.when(F.col("l_tax") > 0, F.col("l_discount") / F.col("l_tax"))
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"), F.round(F.avg("cents"), 6).alias("mean_cents"), F.median("cents").alias("median_cents"), F.round(F.avg(ratio), 8).alias("mean_ratio"))


def block_daily_approximate(spark: SparkSession, d: str) -> DataFrame:
    """The same medians with bounded error, and how far they are from the exact ones in rank: never beyond 1 %."""
    rows = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_extendedprice")
    near = rows.groupBy("day").agg(F.approx_percentile("l_extendedprice", 0.5, 1_000).alias("m"))
    off = rows.join(near, "day").groupBy("day").agg((F.abs(F.count_if(F.col("l_extendedprice") <= F.col("m")) / F.count("*") - 0.5) > 0.01 + 1 / F.count("*")).alias("bad"))
    return off.agg(F.count("*").alias("days"), F.count_if("bad").alias("beyond"))


def describe_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "position_metrics")
    out = describe(rows, ["holding_days", "il_loss_on_initial", "lp_total_return_realized_fee"], [0.05, 0.25, 0.5, 0.75, 0.95])
    return out.select("column_name", *[F.round(c, 8).alias(c) if c != "n" else "n" for c in out.columns[1:]])


def quantile_tails(spark: SparkSession, d: str) -> DataFrame:
    """Tails of a column with infinities as nulls, exact."""
    probabilities = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    rows = table(spark, d, "position_metrics").select(finite("pl_loss_on_initial").alias("v"))
    q = rows.agg(F.percentile("v", F.array(*[F.lit(p) for p in probabilities])).alias("q"))
    cells = F.array(*[F.struct(F.lit(p).alias("probability"), F.round(F.col("q")[i], 10).alias("quantile")) for i, p in enumerate(probabilities)])
    return q.select(F.explode(cells).alias("x")).select("x.*")


def cohort_medians(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "position_metrics").filter(F.col("entry_timestamp").isNotNull())
    return rows.groupBy(F.date_format("entry_timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.median(finite("holding_days")), 8).alias("median_days"), F.round(F.avg(finite("holding_days")), 8).alias("mean_days"))


def cohort_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Nested samples of pairs with their shares of all."""
    p = pairs(spark, d)
    later, clear = F.col("exit_block_number") > F.col("entry_block_number"), F.col("candidate_count") == 1
    alone = F.col("exit_base_position") - F.col("entry_base_position") == 1
    steps = {"all": F.lit(True), "later_block": later, "unambiguous": later & clear, "undisturbed": later & clear & alone}
    counts = p.agg(*[F.count_if(c).alias(n) for n, c in steps.items()])
    cells = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("sample"), F.col(n).alias("n"), F.round(100.0 * F.col(n) / F.col("all"), 8).alias("share_pct")) for i, n in enumerate(steps)])
    return counts.select(F.explode(cells).alias("x")).select("x.*")


def exclusion_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of overlapping exclusions: one row may be in several."""
    o = table(spark, d, "operation_pairs")
    rules = {"no_entry_block": F.col("entry_block_number").isNull(), "no_exit_block": F.col("exit_block_number").isNull(), "no_tick": F.col("tick_lower").isNull(), "not_after": F.col("exit_block_number") <= F.col("entry_block_number"), "same_block": F.col("is_same_block")}
    counts = o.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("n")) for n in rules])).alias("x")).select("x.*")


def inconsistent_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Transactions whose messages disagree on the block or the place in it."""
    rows = table(spark, d, "pool_events").select(hex_text("transaction_hash").alias("hash"), "block_number", "transaction_index")
    return inconsistent(rows, ["hash"], ["block_number", "transaction_index"])


def spearman_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "position_metrics")
    parts = [spearman(rows, "holding_days", y).select(F.lit(y).alias("against"), "n", F.round("rho", 8).alias("rho")) for y in ("il_loss_on_initial", "initial_wealth_usdt")]
    return together(parts)


def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks with ties averaged, within each feed."""
    rows = table(spark, d, "oracle").filter("price > 0 AND price < 1e12").select("feed_id", "price")
    return value_ranks(rows, "price", ["feed_id"]).select("feed_id", "price", "rank")


def regime_labels(spark: SparkSession, d: str) -> DataFrame:
    """Bear, bull and middle markets by the quartiles of the price move; the lower bound is tested first."""
    rows = table(spark, d, "position_metrics").select(hex_text("operation_id").alias("id"), "built_at", (F.col("token0_price_usdt_exit") / F.nullif(F.col("token0_price_usdt_entry"), F.lit(0.0)) - 1).alias("move"))
    rows = rows.filter(finite("move").isNotNull())
    q = rows.agg(F.percentile("move", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    label = F.when(F.col("move") <= F.col("q")[0], "Bear").when(F.col("move") >= F.col("q")[1], "Bull").otherwise("Middle")
    return rows.join(F.broadcast(q), F.lit(True)).groupBy(label.alias("regime")).agg(F.count("*").alias("n"), F.round(F.min("move"), 10).alias("lowest"), F.round(F.max("move"), 10).alias("highest"))


def monthly_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Weighted returns by month of exit, over all positions and short and long ones; every month of the span has a row."""
    rows = table(spark, d, "position_metrics").select(F.date_trunc("month", "exit_timestamp").cast("date").alias("month"), finite("initial_wealth_usdt").alias("w"), finite("il_loss_on_initial").alias("x"), finite("holding_days").alias("days"))
    rows = rows.filter("month IS NOT NULL AND w > 0 AND x IS NOT NULL").withColumn("sample", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("days") < 7, "short"), F.when(F.col("days") >= 7, "long")))))
    sums = rows.groupBy("sample", "month").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("x")).alias("loss"), F.sum("w").alias("capital"))
    spans = sums.groupBy("sample").agg(F.min("month").alias("a"), F.max("month").alias("z")).select("sample", F.explode(F.expr("sequence(a, z, interval 1 month)")).alias("month"))
    return spans.join(sums, ["sample", "month"], "left").select("sample", F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"), F.round(100 * F.col("loss") / F.col("capital"), 6).alias("loss_pct"))


_MODELS = ("il_loss_on_initial", "lvr_rebalancing_on_initial", "pl_loss_on_initial")


def _tracking(spark: SparkSession, d: str) -> DataFrame:
    """Fits over all rows where both values are finite."""
    rows = table(spark, d, "position_metrics").withColumn("year", F.year("exit_timestamp"))
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), finite(m).alias("x")) for m in _MODELS])).alias("m")
    rows = rows.select("year", finite("lp_total_return_realized_fee").alias("y"), long).select("year", "y", "m.*")
    return simple_regression(rows, "x", "y", ["year", "metric"])


def ols_tracking(spark: SparkSession, d: str) -> DataFrame:
    """Regression of the return on each measure by year."""
    out = _tracking(spark, d)
    return out.select("year", "metric", "n", *[F.round(c, 8).alias(c) for c in ("intercept", "slope", "r_squared", "rmse")])


def best_tracker(spark: SparkSession, d: str) -> DataFrame:
    """The measure that explains most of each year; ties to the first name."""
    w = Window.partitionBy("year").orderBy(F.desc(F.round("r_squared", 8)), "metric")
    return _tracking(spark, d).filter("r_squared IS NOT NULL").withColumn("k", F.row_number().over(w)).filter("k = 1").select("year", "metric", "n")


def price_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Counts of trades in 20 equal price bins up to 200; beyond it in the last."""
    rows = ledger(spark, d).filter("kind = 'Swap'")
    return rows.groupBy(F.least(F.floor(F.col("price") / 10), F.lit(20)).alias("bin")).agg(F.count("*").alias("n"))


def quality_violations(spark: SparkSession, d: str) -> DataFrame:
    """All rules over the pairs, their ledger, and the daily tables, as one row a rule."""
    p, events = pairs(spark, d), ledger(spark, d)
    rules = {"entry_before_exit": F.col("entry_order_key") < F.col("exit_order_key"), "depth_above_zero": F.col("depth") > 0, "range_in_order": F.col("low") < F.col("high"), "times_agree": F.col("entry_sec") <= F.col("exit_sec"), "has_candidates": F.col("candidate_count") >= 1}
    daily = table(spark, d, "portfolio_daily").select(hex_text("pool_address").alias("pool_address"), "date", "position_day_count")
    openings = p.select(F.col("entry_log_index").alias("log_index"))
    return together([
        count_violations(p, rules), repeated_keys(p, ["entry_log_index"], "opening_used_once"), repeated_keys(p, ["exit_log_index"], "closing_used_once"),
        unmatched(openings, events.select("log_index"), ["log_index"], "opening_in_ledger"), repeated_keys(daily, ["pool_address", "date"], "one_row_a_day"),
        count_violations(daily, {"count_known": F.col("position_day_count").isNotNull(), "count_not_negative": F.coalesce(F.col("position_day_count") >= 0, F.lit(True))}),
    ])


def raw_log_extract(spark: SparkSession, d: str) -> DataFrame:
    """Embedded SQL: a half-open range of time and blocks of standing logs of chosen kinds."""
    table(spark, d, "pool_events").createOrReplaceTempView("raw_logs")
    return spark.sql("""
        SELECT block_number, lower(trim(transaction_hash)) AS transaction_hash, log_index, lower(trim(event_type)) AS kind, to_json(array(lower(trim(event_type)), owner)) AS topics
        FROM raw_logs
        WHERE NOT (removed <=> true) AND lower(trim(event_type)) IN ('mint', 'burn', 'swap', 'collect', 'initialize')
          AND block_number >= 12000000 AND block_number < 15000000 AND block_timestamp >= timestamp '2021-06-01' AND block_timestamp < timestamp '2022-06-01'""")


def sender_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Embedded SQL: rows whose hash is in a set, each hash once."""
    table(spark, d, "pool_events").createOrReplaceTempView("raw_logs")
    table(spark, d, "operation_pairs").createOrReplaceTempView("known_pairs")
    return spark.sql("""
        SELECT lower(trim(transaction_hash)) AS transaction_hash, max(lower(trim(sender))) AS sender, count(*) AS messages
        FROM raw_logs LEFT SEMI JOIN known_pairs ON lower(trim(raw_logs.transaction_hash)) = lower(trim(known_pairs.entry_transaction_hash))
        GROUP BY 1""")


def month_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Half-open month ranges that cover the orders' span, the last cut at its end."""
    span = table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.date_add(F.to_date(F.max("o_orderdate")), 1).alias("z"))
    months = span.select("a", "z", F.explode(F.expr("sequence(date_trunc('month', a), date_trunc('month', date_sub(z, 1)), interval 1 month)")).alias("m"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd")
    return months.select(show(F.greatest(F.col("a"), F.col("m").cast("date"))).alias("range_start"), show(F.least(F.col("z"), F.add_months("m", 1))).alias("range_end"))


QUERIES = {f.__name__: f for f in (sender_audit, one_to_one_audit, linked_events, customers_without_orders, scalar_row, rate_lookup, block_daily, block_daily_approximate, describe_metrics, quantile_tails, cohort_medians, cohort_funnel, exclusion_counts, inconsistent_transactions, spearman_rank, average_ranks, regime_labels, monthly_cohorts, ols_tracking, best_tracker, price_histogram, quality_violations, raw_log_extract, sender_lookup, month_ranges)}

_DESCRIBED = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CASE WHEN isfinite({c}) THEN {c} END AS v FROM position_metrics" for c in ("holding_days", "il_loss_on_initial", "lp_total_return_realized_fee"))
_PICK = {m: f"SELECT year(exit_timestamp AT TIME ZONE 'UTC')::INT AS year, '{m}' AS metric, lp_total_return_realized_fee AS y, {m} AS x FROM position_metrics WHERE isfinite(lp_total_return_realized_fee) AND isfinite({m})" for m in _MODELS}
_FITS = f"WITH p AS ({' UNION ALL '.join(_PICK.values())}), f AS (SELECT year, metric, count(*) AS n, regr_intercept(y, x) AS intercept, regr_slope(y, x) AS slope, regr_r2(y, x) AS r_squared FROM p GROUP BY 1, 2), e AS (SELECT p.year, metric, sqrt(avg(pow(y - intercept - slope * x, 2))) AS rmse FROM p JOIN f USING (metric) WHERE p.year IS NOT DISTINCT FROM f.year GROUP BY 1, 2), t AS (SELECT f.year, metric, n, CASE WHEN n >= 3 THEN intercept END AS intercept, CASE WHEN n >= 3 THEN slope END AS slope, CASE WHEN n >= 3 THEN r_squared END AS r_squared, CASE WHEN n >= 3 THEN rmse END AS rmse FROM f JOIN e ON f.metric = e.metric AND f.year IS NOT DISTINCT FROM e.year)".replace("t AS (SELECT f.year, metric,", "t AS (SELECT f.year, f.metric,")
_RANKS = lambda y: f"(SELECT '{y}' AS against, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM (SELECT holding_days AS x, {y} AS y FROM position_metrics WHERE isfinite(holding_days) AND isfinite({y}))))"
SQL = {
    "sender_audit": "SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey IS NULL) AS orphans, count(DISTINCT c_custkey) AS senders, (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)) AS repeated FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "one_to_one_audit": "WITH a AS (SELECT lower(trim(operation_id)) AS id, max(lower(trim(pool_address))) AS p FROM operation_pairs GROUP BY 1), b AS (SELECT lower(trim(operation_id)) AS id, max(lower(trim(pool_address))) AS q FROM position_metrics GROUP BY 1) SELECT count(*) FILTER (WHERE q IS NULL) AS left_only, count(*) FILTER (WHERE p IS NULL) AS right_only, count(*) FILTER (WHERE p IS NOT NULL AND q IS NOT NULL) AS matched, count(*) FILTER (WHERE p <> q) AS disagree FROM a FULL JOIN b USING (id)",
    "linked_events": f"WITH {M} SELECT log_index, wallet, tick_lower, tick_upper FROM l WHERE kind = 'Collect' AND (wallet, tick_lower, tick_upper) IN (SELECT (wallet, tick_lower, tick_upper) FROM pairs)",
    "customers_without_orders": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "scalar_row": f"WITH {L}, n AS (SELECT max(block_number) AS latest_block FROM l) SELECT latest_block, arg_max(block_number, order_key) AS final_block, arg_max(log_index, order_key) AS final_log_index FROM l, n WHERE block_number <= latest_block - 64 GROUP BY 1",
    "rate_lookup": f"WITH {L}, e AS (SELECT DATE '1970-01-01' + (sec // 86400)::INT AS date, count(*) AS n FROM l GROUP BY 1), r AS (SELECT date, max(sofr_percent) AS percent FROM portfolio_daily GROUP BY 1) SELECT strftime(e.date, '%Y-%m-%d') AS date, n, percent FROM e LEFT JOIN r USING (date)",
    "block_daily": "WITH l AS (SELECT l_shipdate::DATE AS day, round(l_extendedprice * 100)::BIGINT AS cents, * FROM lineitem) SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key, round(avg(cents), 6) AS mean_cents, quantile_cont(cents::DOUBLE, 0.5) AS median_cents, round(avg(CASE WHEN l_tax > 0 THEN l_discount / l_tax END), 8) AS mean_ratio FROM l GROUP BY 1",
    "block_daily_approximate": "SELECT count(DISTINCT l_shipdate::DATE) AS days, 0::BIGINT AS beyond FROM lineitem",
    "describe_metrics": f"WITH v AS ({_DESCRIBED}) SELECT column_name, count(v) AS n, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS std, round(min(v), 8) AS min, {', '.join(f'round(quantile_cont(v, {p}), 8) AS p{round(100 * p):02d}' for p in (0.05, 0.25, 0.5, 0.75, 0.95))}, round(max(v), 8) AS max FROM v GROUP BY 1",
    "quantile_tails": " UNION ALL ".join(f"SELECT {p}::DOUBLE AS probability, round(quantile_cont(pl_loss_on_initial, {p}), 10) AS quantile FROM position_metrics WHERE isfinite(pl_loss_on_initial)" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)),
    "cohort_medians": "SELECT strftime(entry_timestamp AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n, round(quantile_cont(CASE WHEN isfinite(holding_days) THEN holding_days END, 0.5), 8) AS median_days, round(avg(CASE WHEN isfinite(holding_days) THEN holding_days END), 8) AS mean_days FROM position_metrics WHERE entry_timestamp IS NOT NULL GROUP BY 1",
    "cohort_funnel": f"WITH {M}, f AS (SELECT *, exit_block_number > entry_block_number AS a, candidate_count = 1 AS b, exit_base_position - entry_base_position = 1 AS c FROM pairs), s AS (SELECT 0 AS step, 'all' AS sample, count(*) AS n FROM f UNION ALL SELECT 1, 'later_block', count(*) FILTER (WHERE a) FROM f UNION ALL SELECT 2, 'unambiguous', count(*) FILTER (WHERE a AND b) FROM f UNION ALL SELECT 3, 'undisturbed', count(*) FILTER (WHERE a AND b AND c) FROM f) SELECT *, round(100.0::DOUBLE * n / (SELECT n FROM s WHERE step = 0), 8) AS share_pct FROM s",
    "exclusion_counts": " UNION ALL ".join(f"SELECT '{n}' AS reason, count(*) FILTER (WHERE {c}) AS n FROM operation_pairs" for n, c in (("no_entry_block", "entry_block_number IS NULL"), ("no_exit_block", "exit_block_number IS NULL"), ("no_tick", "tick_lower IS NULL"), ("not_after", "exit_block_number <= entry_block_number"), ("same_block", "is_same_block"))),
    "inconsistent_transactions": "SELECT * FROM (SELECT lower(trim(transaction_hash)) AS hash, count(DISTINCT block_number) + max((block_number IS NULL)::INT) AS block_number_values, count(DISTINCT transaction_index) + max((transaction_index IS NULL)::INT) AS transaction_index_values FROM pool_events GROUP BY 1) WHERE block_number_values > 1 OR transaction_index_values > 1",
    "spearman_rank": f"SELECT * FROM {_RANKS('il_loss_on_initial')} UNION ALL SELECT * FROM {_RANKS('initial_wealth_usdt')}",
    "average_ranks": "SELECT DISTINCT feed_id, price, rank() OVER (PARTITION BY feed_id ORDER BY price) + (count(*) OVER (PARTITION BY feed_id, price) - 1) / 2 AS rank FROM oracle WHERE isfinite(price) AND price > 0",
    "regime_labels": "WITH m AS (SELECT token0_price_usdt_exit / nullif(token0_price_usdt_entry, 0) - 1 AS move FROM position_metrics), r AS (SELECT move FROM m WHERE isfinite(move)), q AS (SELECT quantile_cont(move, 0.25) AS a, quantile_cont(move, 0.75) AS b FROM r) SELECT CASE WHEN move <= a THEN 'Bear' WHEN move >= b THEN 'Bull' ELSE 'Middle' END AS regime, count(*) AS n, round(min(move), 10) AS lowest, round(max(move), 10) AS highest FROM r, q GROUP BY 1",
    "monthly_cohorts": "WITH r AS (SELECT date_trunc('month', exit_timestamp AT TIME ZONE 'UTC')::DATE AS month, initial_wealth_usdt AS w, il_loss_on_initial AS x, CASE WHEN isfinite(holding_days) THEN holding_days END AS days FROM position_metrics WHERE exit_timestamp IS NOT NULL AND isfinite(initial_wealth_usdt) AND initial_wealth_usdt > 0 AND isfinite(il_loss_on_initial)), s AS (SELECT 'all' AS sample, * FROM r UNION ALL SELECT 'short', * FROM r WHERE days < 7 UNION ALL SELECT 'long', * FROM r WHERE days >= 7), g AS (SELECT sample, month, count(*) AS n, 100 * sum(w * x) / sum(w) AS loss_pct FROM s GROUP BY 1, 2), c AS (SELECT sample, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM g GROUP BY 1) SELECT c.sample, strftime(c.month, '%Y-%m') AS month, coalesce(n, 0) AS n, round(loss_pct, 6) AS loss_pct FROM c LEFT JOIN g USING (sample, month)",
    "ols_tracking": f"{_FITS} SELECT year, metric, n, round(intercept, 8) AS intercept, round(slope, 8) AS slope, round(r_squared, 8) AS r_squared, round(rmse, 8) AS rmse FROM t",
    "best_tracker": f"{_FITS} SELECT year, metric, n FROM t WHERE r_squared IS NOT NULL QUALIFY row_number() OVER (PARTITION BY year ORDER BY round(r_squared, 8) DESC, metric) = 1",
    "price_histogram": f"WITH {L} SELECT least(floor(price / 10)::BIGINT, 20) AS bin, count(*) AS n FROM l WHERE kind = 'Swap' GROUP BY 1",
    "quality_violations": f"""WITH {M}, d AS (SELECT lower(trim(pool_address)) AS p, date, position_day_count AS c FROM portfolio_daily)
SELECT 'entry_before_exit' AS rule, count(*) FILTER (WHERE NOT entry_order_key < exit_order_key) AS violations FROM pairs UNION ALL SELECT 'depth_above_zero', count(*) FILTER (WHERE depth <= 0) FROM pairs UNION ALL SELECT 'range_in_order', count(*) FILTER (WHERE low >= high) FROM pairs UNION ALL SELECT 'times_agree', count(*) FILTER (WHERE entry_sec > exit_sec) FROM pairs UNION ALL SELECT 'has_candidates', count(*) FILTER (WHERE candidate_count < 1) FROM pairs
UNION ALL SELECT 'opening_used_once', count(*) FROM (SELECT 1 FROM pairs GROUP BY entry_log_index HAVING count(*) > 1) UNION ALL SELECT 'closing_used_once', count(*) FROM (SELECT 1 FROM pairs GROUP BY exit_log_index HAVING count(*) > 1) UNION ALL SELECT 'opening_in_ledger', count(*) FROM pairs WHERE entry_log_index NOT IN (SELECT log_index FROM l)
UNION ALL SELECT 'one_row_a_day', count(*) FROM (SELECT 1 FROM d GROUP BY p, date HAVING count(*) > 1) UNION ALL SELECT 'count_known', count(*) FILTER (WHERE c IS NULL) FROM d UNION ALL SELECT 'count_not_negative', count(*) FILTER (WHERE c < 0) FROM d""",
    "raw_log_extract": "SELECT block_number, lower(trim(transaction_hash)) AS transaction_hash, log_index, lower(trim(event_type)) AS kind, to_json([lower(trim(event_type)), owner])::VARCHAR AS topics FROM pool_events WHERE removed IS NOT TRUE AND lower(trim(event_type)) IN ('mint', 'burn', 'swap', 'collect', 'initialize') AND block_number >= 12000000 AND block_number < 15000000 AND block_timestamp >= TIMESTAMPTZ '2021-06-01 00:00:00+00' AND block_timestamp < TIMESTAMPTZ '2022-06-01 00:00:00+00'",
    "sender_lookup": "SELECT lower(trim(transaction_hash)) AS transaction_hash, max(lower(trim(sender))) AS sender, count(*) AS messages FROM pool_events WHERE lower(trim(transaction_hash)) IN (SELECT lower(trim(entry_transaction_hash)) FROM operation_pairs) GROUP BY 1",
    "month_ranges": "WITH s AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE + 1 AS z FROM orders), m AS (SELECT a, z, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', z - 1)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM s) SELECT strftime(greatest(a, m), '%Y-%m-%d') AS range_start, strftime(least(z, (m + INTERVAL 1 MONTH)::DATE), '%Y-%m-%d') AS range_end FROM m",
}
