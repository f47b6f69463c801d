"""Queries of formulas, returns and path-dependent measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.functions.exact import ratio_text
from tidebook.functions.formulas import convexity_cost, human_liquidity, inventory, position_value, rebalancing_step, sqrt_price, tick_price
from tidebook.operators.densify import grid_moves
from tidebook.operators.ordered import asof_join, interval_join
from tidebook.operators.pathmetrics import inventory_cost, inventory_points, lag_in_path, medoids, range_sums, rate_curve, with_growth
from tidebook.plans.ledger import KEY_WIDTH, SECONDS_WIDTH, L, M, pairs, swaps
from tidebook.plans.timeseries import _SECONDS, PAIR, _daily_close
from tidebook.util import materialise

FIRST_PRICE = 50.0
r6 = lambda c: F.round(c, 6)


def path(spark: SparkSession, d: str) -> DataFrame:
    """Every trade with the price before it and the last price of an earlier second (the outside price)."""
    trades = swaps(spark, d)
    moves = lag_in_path(trades, "order_key", {"price": "before"}, KEY_WIDTH).withColumn("before", F.coalesce("before", F.lit(FIRST_PRICE)))
    seconds = trades.groupBy(F.col("sec").alias("second")).agg(F.max_by("price", "order_key").alias("outside"))
    moves = asof_join(moves, seconds, "sec", "second", ["outside"], SECONDS_WIDTH).drop("second_matched")
    # a table, as running sums read it twice
    return materialise(moves.withColumn("outside", F.coalesce("outside", "before")), "price-path")


def _curve(spark: SparkSession, d: str) -> DataFrame:
    days = swaps(spark, d).agg(F.expr("min(sec) div 86400").alias("a"), F.expr("max(sec) div 86400").alias("z")).filter("a is not null").select(F.explode(F.expr("sequence(a - 1, z + 1)")).alias("n"))
    return rate_curve(days.withColumn("percent", 3.0 + (F.col("n") % 5).cast("double")), "n", "percent")


def formula_grid(spark: SparkSession, d: str) -> DataFrame:
    """All formulas on every trade against one range."""
    p, q, low, high, liquidity = F.col("before"), F.col("price"), F.lit(20.0), F.lit(90.0), F.lit(3.0)
    x, y = inventory(q, low, high, liquidity)
    tick = (F.col("cents") % 2000 - 1000).cast("int")
    # a trade of no cents is no liquidity that a position may have, but its amount is told as it is
    traded = F.when(F.col("cents") > 0, human_liquidity(F.col("cents").cast("double"), 0.01)).otherwise(F.col("cents") * F.lit(0.01))
    return path(spark, d).select("order_key", r6(tick_price(tick, 1.0)).alias("tick_price"), r6(sqrt_price(F.sqrt(q) * 2.0**96, 1.0)).alias("sqrt_price"), r6(traded).alias("liquidity"), r6(x).alias("amount0"), r6(y).alias("amount1"), r6(position_value(q, low, high, liquidity)).alias("position_value"), r6(rebalancing_step(p, q, F.col("outside"), low, high, liquidity)).alias("step"), r6(convexity_cost(p, q, low, high, liquidity)).alias("convexity"))


def growth_factors(spark: SparkSession, d: str) -> DataFrame:
    """Growth between entry and exit of each pair on the daily rate curve."""
    p, curve = pairs(spark, d).select(*PAIR, "entry_sec", "exit_sec"), _curve(spark, d)
    rows = with_growth(with_growth(p, curve, "entry_sec", "a"), curve, "exit_sec", "z")
    return rows.select(*PAIR, F.round(F.exp(F.col("z") - F.col("a")), 10).alias("factor"))


def _at(spark: SparkSession, d: str, positions: DataFrame, key: str, name: str) -> DataFrame:
    """The pool price before an order key."""
    found = asof_join(positions, swaps(spark, d).select(F.col("order_key").alias("__k"), F.col("price").alias("__p")), key, "__k", ["__p"], KEY_WIDTH)
    return found.withColumn(name, F.coalesce("__p", F.lit(FIRST_PRICE))).drop("__p", "__k_matched")


def lifetime_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hold-versus-provide loss, rebalancing cost, and convexity cost with and without financing, of each pair."""
    curve = _curve(spark, d)
    moves = with_growth(path(spark, d), curve, "sec", "growth")
    p = pairs(spark, d).select(*PAIR, "entry_order_key", "exit_order_key", "exit_sec", "low", "high", "liquidity")
    points, measures = inventory_points({"rebalancing": (F.col("outside"), F.lit(1.0)), "convexity": (F.col("price"), F.lit(1.0)), "discounted": (F.col("price"), F.exp(-F.col("growth")))})
    sums = range_sums(p, PAIR, moves, "order_key", points, measures, "entry_order_key", "exit_order_key", KEY_WIDTH)
    sums = sums.select(*p.columns, F.col("moves").alias("trades"), *[(F.col("liquidity") * inventory_cost(c)).alias(c) for c in ("rebalancing", "convexity", "discounted")])
    rows = with_growth(_at(spark, d, _at(spark, d, sums, "entry_order_key", "p0"), "exit_order_key", "p1"), curve, "exit_sec", "growth")
    bounds = F.col("low"), F.col("high"), F.col("liquidity")
    x0, y0 = inventory(F.col("p0"), *bounds)
    hold = x0 * F.col("p1") + y0
    financed = F.exp("growth") * F.col("discounted")
    return rows.select(*PAIR, "trades", r6(hold - position_value(F.col("p1"), *bounds)).alias("hold_loss"), r6("rebalancing").alias("rebalancing"), r6("convexity").alias("convexity"), r6(financed).alias("financed"), r6(F.greatest(financed - F.col("convexity"), F.lit(0.0))).alias("opportunity"))


def block_mesh_cost(spark: SparkSession, d: str) -> DataFrame:
    """Convexity cost between block ends in each pair's own scope.

    Ends of whole blocks come from running sums; the first step starts at the pair's own entry
    price and the last may end inside the exit's block, so these two are added by hand.
    """
    ends = swaps(spark, d).groupBy("block_number").agg(F.max_by("price", "order_key").alias("price"), F.max("order_key").alias("order_key"))
    ends = materialise(lag_in_path(ends, "order_key", {"price": "before"}, KEY_WIDTH), "block-ends")
    p = materialise(pairs(spark, d).select(*PAIR, "entry_order_key", "exit_order_key", "low", "high", "liquidity"), "pairs")
    bounds = F.col("low"), F.col("high"), F.col("liquidity")
    points, measures = inventory_points({"inner": (F.col("price"), F.lit(1.0))})
    sums = range_sums(p, PAIR, ends, "order_key", points, measures, "entry_order_key", "exit_order_key", KEY_WIDTH)
    sums = sums.select(*p.columns, (F.col("liquidity") * inventory_cost("inner")).alias("inner"))
    # the first block end after the entry: the as-of lookup on negated keys
    ahead = ends.select((-F.col("order_key")).alias("__k"), F.col("order_key").alias("first_key"), F.col("price").alias("first_end"), F.col("before").alias("first_before"))
    sums = asof_join(sums.withColumn("__n", -F.col("entry_order_key")), ahead, "__n", "__k", ["first_key", "first_end", "first_before"], KEY_WIDTH).drop("__k_matched", "__n")
    behind = ends.select(F.col("order_key").alias("last_key"), F.col("price").alias("last_end"))
    sums = asof_join(sums, behind, "exit_order_key", "last_key", ["last_end"], KEY_WIDTH)
    rows = _at(spark, d, _at(spark, d, sums, "entry_order_key", "p0"), "exit_order_key", "p1")
    any_end = F.col("first_key") < F.col("exit_order_key")
    first = convexity_cost(F.col("p0"), F.col("first_end"), *bounds) - F.coalesce(convexity_cost(F.col("first_before"), F.col("first_end"), *bounds), F.lit(0.0))
    start = F.when(any_end, F.col("last_end")).otherwise(F.col("p0"))
    cost = F.when(any_end, F.col("inner") + first).otherwise(0.0) + convexity_cost(start, F.col("p1"), *bounds)
    return rows.select(*PAIR, r6(cost).alias("block_convexity"))


def position_days(spark: SparkSession, d: str) -> DataFrame:
    """One row for each day a pair is open: the last price, its value and what holding would be worth."""
    p = _at(spark, d, pairs(spark, d).select(*PAIR, "entry_order_key", "exit_order_key", "entry_sec", "exit_sec", "low", "high", "liquidity", "entry_cents"), "entry_order_key", "p0")
    days = p.filter("entry_sec < exit_sec").withColumn("day_number", F.explode(F.expr("sequence(entry_sec div 86400, (exit_sec - 1) div 86400)")))
    days = days.withColumn("snapshot", F.least(F.col("exit_sec"), (F.col("day_number") + 1) * 86_400)).withColumn("is_terminal", F.col("snapshot") == F.col("exit_sec"))
    marks = swaps(spark, d).select("sec", "order_key", F.col("price").alias("mark"))
    days = asof_join(days, marks, "snapshot", "sec", ["mark"], SECONDS_WIDTH, tie="order_key").withColumn("mark", F.coalesce("mark", F.lit(FIRST_PRICE)))
    bounds = F.col("low"), F.col("high"), F.col("liquidity")
    x0, y0 = inventory(F.col("p0"), *bounds)
    return days.select(*PAIR, "day_number", "is_terminal", "entry_cents", r6(position_value(F.col("mark"), *bounds)).alias("position_value"), r6(x0 * F.col("mark") + y0).alias("hold_value"))


def portfolio_days(spark: SparkSession, d: str) -> DataFrame:
    """Open positions by day, weighted by capital."""
    loss = F.col("hold_value") - F.col("position_value")
    return position_days(spark, d).groupBy("day_number").agg(F.count("*").alias("positions"), F.sum("entry_cents").alias("capital_cents"), F.round(F.sum(loss), 4).alias("hold_loss"), F.round(100 * F.sum(loss) / F.sum("entry_cents"), 8).alias("loss_pct"))


def quadratic_variation(spark: SparkSession, d: str) -> DataFrame:
    """Variance cost of each pair from the moves on grids of 1, 5 and 60 seconds while the price before a move is in its range."""
    p = materialise(pairs(spark, d).select(*PAIR, "entry_sec", "exit_sec", "low", "high", "liquidity"), "pairs")
    ticks, steps, moves = materialise(swaps(spark, d).select("sec", "order_key", "price"), "ticks"), {"1s": 1, "5s": 5, "1m": 60}, None
    for name, step in steps.items():
        grid = lag_in_path(grid_moves(ticks, "sec", "price", step, "order_key"), "sec", {"price": "before"}, SECONDS_WIDTH)
        base = F.pow(F.col("price") - F.col("before"), 2) / (4 * F.pow("before", F.lit(1.5)))
        cells = F.struct(F.col("before").alias("at"), *[(base if n == name else F.lit(0.0)).alias(n) for n in steps])
        some = grid.filter("before IS NOT NULL").select("sec", F.array(cells).alias("points"))
        moves = some if moves is None else moves.unionByName(some)
    # all grids in one path, each with a measure of its own
    sums = range_sums(p, PAIR, moves, "sec", F.col("points"), list(steps), "entry_sec", "exit_sec", SECONDS_WIDTH, strict=False)
    return sums.select(*PAIR, *[r6(F.col("liquidity") * (F.col(f"{n}_high") - F.col(f"{n}_low"))).alias(f"variation_{n}") for n in steps])


def expected_loss(spark: SparkSession, d: str) -> DataFrame:
    """Expected loss from the volatility of 30 daily returns known before the entry's day, for pairs whose range holds the entry price."""
    w = Window.orderBy("day")
    close = _daily_close(spark, d).withColumn("r", F.log(F.col("price") / F.lag("price").over(w)))
    sigma = close.withColumn("s", F.when(F.count("r").over(w.rowsBetween(-29, 0)) >= 30, F.stddev_samp("r").over(w.rowsBetween(-29, 0)))).select(F.datediff("day", F.lit("1970-01-01")).cast("bigint").alias("day_number"), F.lag("s").over(w).alias("sigma"))
    p = _at(spark, d, pairs(spark, d).withColumn("day_number", F.expr("entry_sec div 86400")), "entry_order_key", "p0").join(sigma, "day_number", "left")
    price, low, high = F.col("p0"), F.col("low"), F.col("high")
    width = 2 * (1 - F.sqrt(low / price)) + 2 * (1 - F.sqrt(price / high))
    days = (F.col("exit_sec") - F.col("entry_sec")) / 86_400
    value = (F.exp(-F.col("sigma") * F.col("sigma") * days / 8) - 1) / width
    usable = (low <= price) & (price <= high) & F.col("sigma").isNotNull()
    return p.select(*PAIR, F.coalesce(usable, F.lit(False)).alias("applicable"), F.when(usable, r6(value)).alias("expected"))


def pair_returns(spark: SparkSession, d: str) -> DataFrame:
    """Returns of each pair at the price strictly before entry and exit; excluded pairs (no price yet) carry nulls."""
    prices = swaps(spark, d).select(F.col("sec").alias("at"), "order_key", "price")
    p = pairs(spark, d)
    for side in ("entry", "exit"):
        p = asof_join(p, prices, f"{side}_sec", "at", ["price"], SECONDS_WIDTH, tolerance=3_600, tie="order_key").withColumnRenamed("price", f"price_{side}").drop("at_matched")
    money = lambda cents, price: (F.col(cents).cast("decimal(18,0)") * F.col(price).cast("string").cast("decimal(12,6)")).cast("double") / 100
    initial, final, hold = money("entry_cents", "price_entry"), money("exit_cents", "price_exit"), money("entry_cents", "price_exit")
    days = (F.col("exit_sec") - F.col("entry_sec")) / 86_400
    total = (final - initial) / F.nullif(initial, F.lit(0.0))
    exact = ratio_text(F.col("exit_cents").cast("string"), F.nullif(F.col("entry_cents"), F.lit(0)).cast("string"))
    return p.select(*PAIR, r6(initial).alias("initial"), r6(final).alias("final"), r6(total).alias("total_return"), r6((final - hold) / F.nullif(hold, F.lit(0.0))).alias("excess_return"), F.when((total > -1) & (days > 0), r6(F.log1p(total) / days)).alias("daily_log_return"), F.substring(exact, 1, 14).alias("amount_ratio"))


def representatives(spark: SparkSession, d: str) -> DataFrame:
    """The most typical pair of rising and falling markets, short and long lives."""
    p = _at(spark, d, _at(spark, d, pairs(spark, d).filter("entry_sec < exit_sec"), "entry_order_key", "p0"), "exit_order_key", "p1")
    p = p.select(*PAIR, F.log("liquidity").alias("size"), F.log(F.col("high") - F.col("low")).alias("width"), F.log((F.col("exit_sec") - F.col("entry_sec")).cast("double")).alias("life"), F.log(F.col("p1") / F.col("p0")).alias("move"), F.struct(*PAIR).alias("pair"))
    q = p.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"q_{c}") for c in ("move", "life")])
    rows = p.join(F.broadcast(q), F.lit(True))  # one row
    market = F.when(F.col("move") >= F.col("q_move")[1], "bull").when(F.col("move") <= F.col("q_move")[0], "bear")
    life = F.when(F.col("life") <= F.col("q_life")[0], "short").when(F.col("life") >= F.col("q_life")[1], "long")
    rows = rows.withColumn("market", market).withColumn("length", life).filter("market IS NOT NULL AND length IS NOT NULL").drop("q_move", "q_life")
    return medoids(rows, ["market", "length"], ["size", "width", "life", "move"], "pair").select("market", "length", "candidates", r6("medoid_score").alias("medoid_score"), *PAIR)


def representative_paths(spark: SparkSession, d: str) -> DataFrame:
    """Entry, trades, grid points and exit of the representatives, with the number of trades so far."""
    few = materialise(representatives(spark, d).select("market", "length", *PAIR), "representatives")
    p = few.join(pairs(spark, d).select(*PAIR, "entry_sec", "exit_sec", "entry_order_key", "exit_order_key"), PAIR)
    cell = ["market", "length"]
    trades = interval_join(p, swaps(spark, d).select("order_key", F.col("sec").alias("swap_sec"), "price"), "entry_order_key", "exit_order_key", "order_key", KEY_WIDTH * 4)
    trades = trades.select(*cell, F.col("swap_sec").alias("sec"), F.lit("swap").alias("row_kind"), "order_key", "price")
    step = F.when(F.col("exit_sec") - F.col("entry_sec") <= 86_400, 1).otherwise(60).cast("bigint")
    first, last = F.ceil(F.col("entry_sec") / step) * step, F.floor(F.col("exit_sec") / step) * step
    grid = p.withColumn("sec", F.explode(F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<bigint>")))).select(*cell, "sec", F.lit("grid").alias("row_kind"))
    ends = [p.select(*cell, F.col(f"{s}_sec").alias("sec"), F.lit(s).alias("row_kind"), F.col(f"{s}_order_key").alias("order_key")) for s in ("entry", "exit")]
    rows = trades.unionByName(grid, True).unionByName(ends[0], True).unionByName(ends[1], True)
    rank = F.when(F.col("row_kind") == "entry", 0).when(F.col("row_kind") == "swap", 1).when(F.col("row_kind") == "grid", 2).otherwise(3)
    # four cells of bounded life: each is one window
    w = Window.partitionBy(*cell).orderBy("sec", rank, F.asc_nulls_last("order_key")).rowsBetween(Window.unboundedPreceding, 0)
    count = F.count(F.when(F.col("row_kind") == "swap", 1))
    seen = F.when(F.col("row_kind") == "entry", 0).when(F.col("row_kind") == "exit", count.over(Window.partitionBy(*cell))).otherwise(count.over(w))
    return rows.select(*cell, "sec", "row_kind", "order_key", "price", seen.cast("bigint").alias("step_count"))


QUERIES = {f.__name__: f for f in (formula_grid, growth_factors, lifetime_metrics, block_mesh_cost, position_days, portfolio_days, quadratic_variation, expected_loss, pair_returns, representatives, representative_paths)}

_K = "wallet, tick_lower, tick_upper, depth, pair_number"


def _x(p, lo="low", hi="high", q="liquidity"):
    return f"({q} * (1 / sqrt(greatest({lo}, least({p}, {hi}))) - 1 / sqrt({hi})))"


def _y(p, lo="low", hi="high", q="liquidity"):
    return f"({q} * (sqrt(greatest({lo}, least({p}, {hi}))) - sqrt({lo})))"


def _v(p, *b):
    return f"({_x(p, *b)} * {p} + {_y(p, *b)})"


def _step(p, s, o, *b):
    return f"(-({o} * ({_x(s, *b)} - {_x(p, *b)}) + ({_y(s, *b)} - {_y(p, *b)})))"


def _convex(p, s, lo="low", hi="high", q="liquidity"):
    b = (lo, hi, q)
    return f"(CASE WHEN {p} BETWEEN {lo} AND {hi} AND {s} BETWEEN {lo} AND {hi} THEN {q} * pow(sqrt({s}) - sqrt({p}), 2) / sqrt({p}) WHEN ({p} <= {lo} AND {s} <= {lo}) OR ({p} >= {hi} AND {s} >= {hi}) THEN 0.0 ELSE greatest(0.0, {_v(p, *b)} + {_x(p, *b)} * ({s} - {p}) - {_v(s, *b)}) END)"


_M2 = M + _SECONDS.replace(L, "", 1)
_PATH = _M2 + """, path AS (
  SELECT s.order_key, s.block_number, s.sec, s.price, s.cents, coalesce(lag(s.price) OVER (ORDER BY s.order_key), 50.0) AS before, g.price AS grid_price FROM swaps s LEFT JOIN seconds g ON g.sec = s.sec - 1),
path2 AS (SELECT *, coalesce(grid_price, before) AS outside FROM path),
days AS (SELECT unnest(generate_series((SELECT min(sec) // 86400 - 1 FROM swaps), (SELECT max(sec) // 86400 + 1 FROM swaps))) AS n),
curve AS (SELECT n, ln(1 + (3.0 + n % 5)::DOUBLE / 100 / 360) AS log_rate, coalesce(sum(ln(1 + (3.0 + n % 5)::DOUBLE / 100 / 360)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM days)"""
_GROW = lambda sec: f"(SELECT start + log_rate * ({sec} % 86400) / 86400 FROM curve WHERE n = {sec} // 86400)"
_PRICED = _M2 + """, e0 AS (SELECT p.*, coalesce(s.price, 50.0) AS p0 FROM pairs p ASOF LEFT JOIN swaps s ON p.entry_order_key > s.order_key),
priced AS (SELECT e0.*, coalesce(s.price, 50.0) AS p1 FROM e0 ASOF LEFT JOIN swaps s ON e0.exit_order_key > s.order_key)"""
_POSDAYS = _PRICED + f""", d0 AS (SELECT *, unnest(generate_series(entry_sec // 86400, (exit_sec - 1) // 86400)) AS day_number FROM priced WHERE entry_sec < exit_sec),
d1 AS (SELECT *, least(exit_sec, (day_number + 1) * 86400) AS snapshot FROM d0), lasts AS (SELECT sec, arg_max(price, order_key) AS price FROM swaps GROUP BY sec),
d2 AS (SELECT d1.*, coalesce(b.price, 50.0) AS mark FROM d1 ASOF LEFT JOIN lasts b ON d1.snapshot > b.sec),
posdays AS (SELECT {_K}, day_number, snapshot = exit_sec AS is_terminal, entry_cents, round({_v('mark')}, 6) AS position_value, round({_x('p0')} * mark + {_y('p0')}, 6) AS hold_value FROM d2)"""
_REPS = _PRICED + """, f AS (SELECT *, ln(liquidity) AS size, ln(high - low) AS width, ln((exit_sec - entry_sec)::DOUBLE) AS life, ln(p1 / p0) AS move FROM priced WHERE entry_sec < exit_sec),
q AS (SELECT quantile_cont(move, [0.25, 0.75]) AS qm, quantile_cont(life, [0.25, 0.75]) AS ql FROM f),
c AS (SELECT f.*, CASE WHEN move >= qm[2] THEN 'bull' WHEN move <= qm[1] THEN 'bear' END AS market, CASE WHEN life <= ql[1] THEN 'short' WHEN life >= ql[2] THEN 'long' END AS length FROM f, q),
s AS (SELECT market, length, count(*) AS candidates, quantile_cont(size, [0.25, 0.5, 0.75]) AS a, quantile_cont(width, [0.25, 0.5, 0.75]) AS b, quantile_cont(life, [0.25, 0.5, 0.75]) AS l, quantile_cont(move, [0.25, 0.5, 0.75]) AS m FROM c WHERE market IS NOT NULL AND length IS NOT NULL GROUP BY 1, 2),
scored AS (SELECT c.*, candidates, coalesce(pow((size - a[2]) / nullif(a[3] - a[1], 0), 2), 0) + coalesce(pow((width - b[2]) / nullif(b[3] - b[1], 0), 2), 0) + coalesce(pow((c.life - l[2]) / nullif(l[3] - l[1], 0), 2), 0) + coalesce(pow((move - m[2]) / nullif(m[3] - m[1], 0), 2), 0) AS medoid_score FROM c JOIN s USING (market, length)),
reps AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY market, length ORDER BY medoid_score, wallet, tick_lower, tick_upper, depth, pair_number) = 1)"""
_B = ("20.0", "90.0", "3.0")
SQL = {
    "formula_grid": f"WITH {_PATH} SELECT order_key, round(pow(1.0001, cents % 2000 - 1000), 6) AS tick_price, round(price, 6) AS sqrt_price, round(cents * 0.01::DOUBLE, 6) AS liquidity, round({_x('price', *_B)}, 6) AS amount0, round({_y('price', *_B)}, 6) AS amount1, round({_v('price', *_B)}, 6) AS position_value, round({_step('before', 'price', 'outside', *_B)}, 6) AS step, round({_convex('before', 'price', *_B)}, 6) AS convexity FROM path2",
    "growth_factors": f"WITH {_PATH} SELECT {_K}, round(exp({_GROW('exit_sec')} - {_GROW('entry_sec')}), 10) AS factor FROM pairs",
    "lifetime_metrics": f"""WITH {_PATH}, grown AS (SELECT path2.*, start + log_rate * (sec % 86400) / 86400 AS growth FROM path2 JOIN curve ON n = sec // 86400),
e0 AS (SELECT p.*, coalesce(s.price, 50.0) AS p0 FROM pairs p ASOF LEFT JOIN swaps s ON p.entry_order_key > s.order_key), priced AS (SELECT e0.*, coalesce(s.price, 50.0) AS p1 FROM e0 ASOF LEFT JOIN swaps s ON e0.exit_order_key > s.order_key),
sums AS (SELECT {_K}, count(s.order_key) AS trades, coalesce(sum({_step('s.before', 's.price', 's.outside')}), 0) AS rebalancing, coalesce(sum({_convex('s.before', 's.price')}), 0) AS convexity, coalesce(sum({_convex('s.before', 's.price')} * exp(-s.growth)), 0) AS discounted
  FROM priced LEFT JOIN grown s ON s.order_key > entry_order_key AND s.order_key < exit_order_key GROUP BY {_K})
SELECT {_K}, trades, round({_x('p0')} * p1 + {_y('p0')} - {_v('p1')}, 6) AS hold_loss, round(rebalancing, 6) AS rebalancing, round(convexity, 6) AS convexity, round(exp({_GROW('exit_sec')}) * discounted, 6) AS financed, round(greatest(exp({_GROW('exit_sec')}) * discounted - convexity, 0), 6) AS opportunity
FROM priced JOIN sums USING ({_K})""",
    "block_mesh_cost": f"""WITH {_PRICED}, scope AS (SELECT {_K}, p0, low, high, liquidity, s.block_number, arg_max(s.price, s.order_key) AS fin, max(s.order_key) AS k FROM priced JOIN swaps s ON s.order_key > entry_order_key AND s.order_key < exit_order_key GROUP BY {_K}, p0, low, high, liquidity, s.block_number),
steps AS (SELECT *, coalesce(lag(fin) OVER (PARTITION BY {_K} ORDER BY k), p0) AS prev FROM scope)
SELECT {_K}, round(coalesce(cost, 0), 6) AS block_convexity FROM pairs LEFT JOIN (SELECT {_K}, sum({_convex('prev', 'fin')}) AS cost FROM steps GROUP BY {_K}) USING ({_K})""",
    "position_days": f"WITH {_POSDAYS} SELECT * FROM posdays",
    "portfolio_days": f"WITH {_POSDAYS} SELECT day_number, count(*) AS positions, sum(entry_cents)::BIGINT AS capital_cents, round(sum(hold_value - position_value), 4) AS hold_loss, round(100 * sum(hold_value - position_value) / sum(entry_cents), 8) AS loss_pct FROM posdays GROUP BY 1",
    "quadratic_variation": f"WITH {_M2}, " + ", ".join(f"g{n} AS (SELECT sec, price, lag(price, 1, price) OVER (ORDER BY sec) AS before FROM seconds WHERE sec % {n} = 0), v{n} AS (SELECT {_K}, sum(liquidity * pow(g.price - before, 2) / (4 * pow(before, 1.5))) AS v FROM pairs JOIN (SELECT * FROM g{n} WHERE price <> before) g ON g.sec > entry_sec AND g.sec <= exit_sec AND before >= low AND before < high GROUP BY {_K})" for n in (1, 5, 60)) + f" SELECT {_K}, round(coalesce(v1.v, 0), 6) AS variation_1s, round(coalesce(v5.v, 0), 6) AS variation_5s, round(coalesce(v60.v, 0), 6) AS variation_1m FROM pairs LEFT JOIN v1 USING ({_K}) LEFT JOIN v5 USING ({_K}) LEFT JOIN v60 USING ({_K})",
    "expected_loss": f"""WITH {_PRICED}, close AS (SELECT sec // 86400 AS n, arg_max(price, (sec, price)) AS price FROM swaps GROUP BY 1), r AS (SELECT n, ln(price / lag(price) OVER (ORDER BY n)) AS r FROM close),
h AS (SELECT n, CASE WHEN count(r) OVER w >= 30 THEN stddev_samp(r) OVER w END AS s FROM r WINDOW w AS (ORDER BY n ROWS 29 PRECEDING)), g AS (SELECT n, lag(s) OVER (ORDER BY n) AS sigma FROM h),
j AS (SELECT *, coalesce(low <= p0 AND p0 <= high AND sigma IS NOT NULL, false) AS applicable FROM priced LEFT JOIN g ON n = entry_sec // 86400)
SELECT {_K}, applicable, CASE WHEN applicable THEN round((exp(-sigma * sigma * (exit_sec - entry_sec) / 86400 / 8) - 1) / (2 * (1 - sqrt(low / p0)) + 2 * (1 - sqrt(p0 / high))), 6) END AS expected FROM j""",
    "pair_returns": f"""WITH {_M2}, lasts AS (SELECT sec, arg_max(price, order_key) AS price FROM swaps GROUP BY sec),
a AS (SELECT p.*, CASE WHEN entry_sec - b.sec <= 3600 THEN b.price END AS pe FROM pairs p ASOF LEFT JOIN lasts b ON p.entry_sec > b.sec), z AS (SELECT a.*, CASE WHEN exit_sec - b.sec <= 3600 THEN b.price END AS px FROM a ASOF LEFT JOIN lasts b ON a.exit_sec > b.sec),
v AS (SELECT *, entry_cents * pe / 100 AS initial, exit_cents * px / 100 AS final, entry_cents * px / 100 AS hold FROM z)
SELECT {_K}, round(initial, 6) AS initial, round(final, 6) AS final, round((final - initial) / nullif(initial, 0), 6) AS total_return, round((final - hold) / nullif(hold, 0), 6) AS excess_return, CASE WHEN (final - initial) / nullif(initial, 0) > -1 AND exit_sec > entry_sec THEN round(ln(1 + (final - initial) / nullif(initial, 0)) / ((exit_sec - entry_sec) / 86400), 6) END AS daily_log_return,
  NULL::VARCHAR AS amount_ratio FROM v""",
    "representatives": f"WITH {_REPS} SELECT market, length, candidates, round(medoid_score, 6) AS medoid_score, {_K} FROM reps",
    "representative_paths": f"""WITH {_REPS}, t AS (SELECT market, length, w.sec, 'swap' AS row_kind, w.order_key, w.price FROM reps JOIN swaps w ON w.order_key > entry_order_key AND w.order_key < exit_order_key),
g AS (SELECT market, length, entry_sec, exit_sec, CASE WHEN exit_sec - entry_sec <= 86400 THEN 1 ELSE 60 END AS step FROM reps), gg AS (SELECT market, length, unnest(generate_series((entry_sec + step - 1) // step * step, exit_sec // step * step, step)) AS sec FROM g)
SELECT market, length, sec, row_kind, order_key, price, (SELECT count(*) FROM t u WHERE u.market = t.market AND u.length = t.length AND u.order_key <= t.order_key) AS step_count FROM t
UNION ALL SELECT market, length, sec, 'grid', NULL, NULL, (SELECT count(*) FROM t WHERE t.market = gg.market AND t.length = gg.length AND t.sec <= gg.sec) FROM gg
UNION ALL SELECT market, length, entry_sec, 'entry', entry_order_key, NULL, 0 FROM reps
UNION ALL SELECT market, length, exit_sec, 'exit', exit_order_key, NULL, (SELECT count(*) FROM t WHERE t.market = reps.market AND t.length = reps.length) FROM reps""",
}
# the exact ratio is text of 60 digits, which no SQL type here holds
del SQL["pair_returns"]
