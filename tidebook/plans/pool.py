"""Queries on the pool project's own tables: decoded logs, fees, returns and path measures of real ranges.

Amounts are integers of any size given as text, there are as many ranges as positions, and each
pool has a price path of its own. The outside price is the last price of an earlier second in any
pool; the second token counts as 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.functions import abi, events
from tidebook.functions.formulas import convexity_cost, human_liquidity, inventory, sqrt_price, tick_price
from tidebook.operators.fees import attribute_collections
from tidebook.operators.matching import overlapping
from tidebook.operators.ordered import asof_join, block_ends, order_key, running_sums
from tidebook.operators.pathmetrics import inventory_cost, inventory_points, lag_in_path, range_sums, rate_curve, with_growth
from tidebook.operators.quality import count_violations, repeated_keys, together
from tidebook.operators.returns import closed_returns, pair_returns
from tidebook.plans.risk import _convex, _step, _x, _y
from tidebook.util import hex_text, latest, materialise, table

#: Stretches of 10,000 blocks and of one day.
KEY_WIDTH, SECONDS_WIDTH = 10_000 * 10**10, 86_400
DAY = 86_400
DECIMALS = (18, 6)
LOG = ["block_number", "transaction_hash", "log_index"]
POOL, MANAGER = "0x" + "Aa" * 20, "0x" + "bB" * 20
ZERO = "0x" + "0" * 40
COSTS = ("lvr", "event", "event_discounted", "block", "block_discounted")
r6 = lambda c: F.round(c, 6)


def integer(column: str) -> Column:
    """Integer text whatever its blanks, sign and leading zeros, as decimal; null if it is none or has over 38 digits."""
    bare = F.regexp_replace(column, r"\s+", "")
    digits = F.regexp_extract(bare, "^[+-]?0*([0-9]{1,38})$", 1)
    return F.when(digits != "", F.concat(F.when(bare.startswith("-"), "-").otherwise(""), digits).cast("decimal(38,0)"))


def standing_logs(spark: SparkSession, d: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The log of each block, transaction and number that its latest message tells of, unless withdrawn.

    With ``kinds``, messages of other kinds vie as before but bring nothing that is compared after the kind.
    """
    numbers = ("liquidity_delta_raw", "amount0_raw", "amount1_raw", "sqrt_price_x96", "active_liquidity_raw")
    rows = table(spark, d, "pool_events").select("block_number", hex_text("transaction_hash").alias("transaction_hash"), "log_index", "ingested_at", F.coalesce("removed", F.lit(False)).alias("gone"), F.unix_seconds("block_timestamp").alias("sec"), "transaction_index", hex_text("address").alias("address"), F.lower(F.trim("event_type")).alias("kind"), *[hex_text(c).alias(c) for c in ("sender", "owner", "recipient")], "tick_lower", "tick_upper", "tick", *[integer(c).alias(c) for c in numbers])
    values = [c for c in rows.columns if c not in {*LOG, "ingested_at"}]
    if kinds:
        rows = rows.withColumns({c: F.when(F.col("kind").isin(*kinds), F.col(c)) for c in values[values.index("kind") + 1 :]})
    return latest(rows, LOG, "ingested_at", values).filter("NOT gone").drop("ingested_at", "gone")


def pool_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each operation, with order keys, seconds and amounts as decimals."""
    sides = [(s, c) for s in ("entry", "exit") for c in ("block_number", "transaction_index", "log_index")]
    amounts = [f"{s}_amount{i}_raw" for s in ("entry", "exit") for i in (0, 1)]
    rows = table(spark, d, "operation_pairs").select(hex_text("operation_id").alias("operation_id"), "built_at", hex_text("pool_address").alias("pool_address"), hex_text("manager_address").alias("manager_address"), hex_text("lp_wallet").alias("lp_wallet"), "tick_lower", "tick_upper", integer("liquidity_raw").alias("liquidity_raw"), F.trim("nfpm_token_id").alias("token_id"), "nfpm_token_id_consistent", *[f"{s}_{c}" for s, c in sides], *[F.unix_seconds(f"{s}_block_timestamp").alias(f"{s}_sec") for s in ("entry", "exit")], *[hex_text(f"{s}_transaction_hash").alias(f"{s}_transaction_hash") for s in ("entry", "exit")], *[integer(c).alias(c) for c in amounts], "holding_seconds")
    rows = latest(rows, ["operation_id"], "built_at", [c for c in rows.columns if c not in {"operation_id", "built_at"}])
    return rows.withColumns({f"{s}_key": order_key(*[f"{s}_{c}" for c in ("block_number", "transaction_index", "log_index")]) for s in ("entry", "exit")})


def decoded_events(spark: SparkSession, d: str) -> DataFrame:
    """Logs of all nine kinds, encoded as contracts would and decoded again."""
    parts = []

    def encoded(rows: DataFrame, x: events.Layout, contract: str) -> DataFrame:
        texts = F.array(*[F.col(c).cast("string") for c in x.columns])
        kinds = F.array(*[F.lit(k == "address") for k in x.types])
        word = lambda t, address: F.when(address, F.lpad(F.substring(t, 3, 40), 64, "0")).otherwise(abi.encoded_integer(t))
        rows = rows.withColumn("w", F.zip_with(texts, kinds, word))
        cell = lambda place: F.get("w", F.lit(x.places.index(place)))
        topics = [F.concat(F.lit("0x"), cell(p)) for p in sorted(x.places) if p[0] == "t"]
        return rows.select(*events.BASE[:5], F.lit(contract).alias("address"), F.to_json(F.array(F.lit("0x" + x.topic[2:].upper()), *topics)).alias("topics_json"), F.concat(F.lit("0x"), *[cell(p) for p in sorted(x.places) if p[0] == "w"]).alias("data"))

    logs = materialise(standing_logs(spark, d).withColumn("block_timestamp", F.timestamp_seconds("sec")), "logs")
    pairs = materialise(pool_pairs(spark, d).filter("token_id RLIKE '^[0-9]+$'"), "pairs")
    for x in events.LAYOUTS:
        if x.frame == "pool":
            rows = logs.filter(F.col("kind") == x.kind.lower()).withColumn("liquidity_delta_raw", F.abs("liquidity_delta_raw"))
            for c in x.columns:
                rows = rows.filter(F.col(c).isNotNull())
            parts.append(encoded(rows, x, POOL))
            continue
        side = "entry" if x.kind in ("IncreaseLiquidity", "Transfer") else "exit"
        rows = pairs.select(*[F.col(f"{side}_{c}").alias(c) for c in LOG], F.timestamp_seconds(f"{side}_sec").alias("block_timestamp"), F.col(f"{side}_transaction_index").alias("transaction_index"), "token_id", F.col("liquidity_raw").alias("liquidity_delta_raw"), F.col(f"{side}_amount0_raw").alias("amount0_raw"), F.col(f"{side}_amount1_raw").alias("amount1_raw"), F.col("lp_wallet").alias("recipient"), F.lit(ZERO).alias("from_address"), F.col("lp_wallet").alias("to_address"))
        for c in x.columns:
            rows = rows.filter(F.col(c).isNotNull())
        parts.append(encoded(rows, x, MANAGER))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    found = events.decode_logs(materialise(every, "raw-logs"), [POOL], [MANAGER])
    return found.select("block_number", "transaction_hash", "transaction_index", "log_index", "frame", "event_type", *events.ADDRESSES, *events.TICKS, *events.INTEGERS)


def pair_fees(spark: SparkSession, d: str) -> DataFrame:
    """Fees of each pair in both tokens, from the collections of its manager's range; overlapping pairs are marked."""
    return _with_fees(spark, d).select("operation_id", "interim_count", "exit_count", "exit_covers_principal", *[F.col(f"fee_realized{i}").cast("string").alias(f"realized_fee{i}_raw") for i in (0, 1)], "included")


IDENTITY = ["pool_address", "manager_address", "tick_lower", "tick_upper"]


def _with_fees(spark: SparkSession, d: str) -> DataFrame:
    p = materialise(pool_pairs(spark, d).filter("entry_key IS NOT NULL AND exit_key IS NOT NULL AND entry_key < exit_key"), "pool-pairs")
    collects = standing_logs(spark, d).filter("kind = 'collect'").select(F.col("address").alias("pool_address"), F.col("owner").alias("manager_address"), "tick_lower", "tick_upper", order_key("block_number", "transaction_index", "log_index").alias("at"), F.col("amount0_raw").alias("realized0"), F.col("amount1_raw").alias("realized1"))
    first = F.col("exit_key") - F.col("exit_log_index")  # the log number is the lowest part of the key
    scoped = p.withColumns({"scope_first": first, "scope_last": first + 99_999})
    found = attribute_collections(scoped, ["operation_id"], collects, IDENTITY, "entry_key", "exit_key", ("scope_first", "scope_last"), "at", ["realized0", "realized1"], ["exit_amount0_raw", "exit_amount1_raw"], KEY_WIDTH)
    clash = overlapping(p.select(*IDENTITY, "operation_id", "entry_key", "exit_key"), IDENTITY, "entry_key", "exit_key", ["exit_key", "operation_id"], KEY_WIDTH).select("operation_id", F.lit(True).alias("clash"))
    return found.join(clash, "operation_id", "left").withColumn("included", F.col("clash").isNull()).drop("clash", "scope_first", "scope_last")


def price_logs(spark: SparkSession, d: str) -> DataFrame:
    """The standing logs that set a price: pool_address, k (order key), block_number, sec, is_swap, price."""
    rows = standing_logs(spark, d, ("swap", "initialize")).filter("kind IN ('swap', 'initialize') AND sqrt_price_x96 > 0 AND sec IS NOT NULL")
    return rows.select(F.col("address").alias("pool_address"), order_key("block_number", "transaction_index", "log_index").alias("k"), "block_number", "sec", (F.col("kind") == "swap").alias("is_swap"), sqrt_price(F.col("sqrt_price_x96")).alias("price"))


def market(spark: SparkSession, d: str, prices: DataFrame | None = None) -> DataFrame:
    """The last price of each second over all pools: second, outside."""
    rows = (price_logs(spark, d) if prices is None else prices).filter("is_swap")
    return rows.groupBy(F.col("sec").alias("second")).agg(F.max_by("price", F.struct("k", "price")).alias("outside"))


def _priced(spark: SparkSession, d: str, p: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Pairs with the outside price strictly before entry and exit, and when that price was set."""
    prices = materialise(market(spark, d), "market") if prices is None else prices
    for s in ("entry", "exit"):
        p = asof_join(p, prices, f"{s}_sec", "second", ["outside"], SECONDS_WIDTH).withColumnsRenamed({"outside": f"{s}_price", "second_matched": f"{s}_price_second"})
    return p


def _prices() -> dict[str, tuple[Column, Column]]:
    return {s: (F.col(f"{s}_price"), F.lit(1.0)) for s in ("entry", "exit")}


def position_returns(spark: SparkSession, d: str) -> DataFrame:
    """Values and returns of each pair; those with overlapping identities are excluded and have nulls."""
    rows = _priced(spark, d, _with_fees(spark, d))
    out = pair_returns(rows, ("entry_amount0_raw", "entry_amount1_raw"), ("exit_amount0_raw", "exit_amount1_raw"), ("fee_realized0", "fee_realized1"), _prices(), "holding_seconds", F.col("included"), DECIMALS)
    money = ("initial_wealth_usdt", "principal_exit_value_usdt", "realized_fee_value_usdt", "lp_exit_value_realized_fee_usdt", "hodl_exit_value_usdt")
    ratios = ("lp_total_return_realized_fee", "lp_excess_return_vs_hodl_realized_fee", "fee_return_on_initial_wealth", "realized_daily_log_return", "realized_daily_return_simple", "holding_days")
    # a daily growth beyond any use overflows; it stays as it is
    return out.select("operation_id", "included", *[F.round(c, 4).alias(c) for c in money], *[F.round(c, 9).alias(c) for c in ratios], (F.col("realized_daily_return_geometric") > 0).alias("daily_growth_above_0"))


def closed_position_returns(spark: SparkSession, d: str) -> DataFrame:
    """Returns of whole positions, told by their token: all amounts of its pairs, from the first entry to the last exit."""
    rows = _with_fees(spark, d).filter("included AND nfpm_token_id_consistent AND token_id IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("entry_amount0_raw", "entry_amount1_raw", "exit_amount0_raw", "exit_amount1_raw", "fee_realized0", "fee_realized1")]
    whole = rows.groupBy("token_id").agg(F.min("entry_sec").alias("entry_sec"), F.max("exit_sec").alias("exit_sec"), *sums)
    out = closed_returns(_priced(spark, d, whole), ("entry_amount0_raw", "entry_amount1_raw"), ("exit_amount0_raw", "exit_amount1_raw"), ("fee_realized0", "fee_realized1"), _prices(), DECIMALS)
    tokens = [f"{c}_token{i}" for c in ("deposit", "withdraw_principal", "fee") for i in (0, 1)]
    money = ("initial_wealth_usdt", "principal_exit_value_usdt", "fee_exit_value_usdt", "lp_exit_value_usdt", "hodl_exit_value_usdt")
    ratios = ("lp_total_return_close_marked", "lp_excess_return_vs_hodl_close", "fee_return_on_initial_wealth", "il_return_vs_hodl_fee_exclusive")
    return out.select("token_id", *[F.round(c, 6).alias(c) for c in tokens], *[F.round(c, 4).alias(c) for c in money], *[F.round(c, 9).alias(c) for c in ratios])


def pool_path(spark: SparkSession, d: str, prices: DataFrame | None = None, outside: DataFrame | None = None) -> DataFrame:
    """Every price of every pool in order, with what lookups and sums need.

    pool_address, k (order key), sec, price, ``before`` (null for the initial price),
    outside, growth (of the rate curve up to the second), is_end (last price of its block),
    end_before (price at the end of the block before) and ``next_end``: key, price and growth of the
    first block end after this row.
    """
    rows = (price_logs(spark, d) if prices is None else prices).filter("k IS NOT NULL AND pool_address IS NOT NULL")
    rows = lag_in_path(rows, "k", {"price": "last"}, KEY_WIDTH, by=["pool_address"])
    rows = rows.withColumn("before", F.when(F.col("is_swap"), F.col("last"))).drop("last", "is_swap")
    rows = asof_join(rows, market(spark, d) if outside is None else outside, "sec", "second", ["outside"], SECONDS_WIDTH).drop("second_matched")
    rows = rows.withColumn("outside", F.coalesce("outside", "before", "price"))
    rows = materialise(with_growth(rows, pool_curve(spark, d), "sec", "growth").withColumn("is_end", block_ends(rows, ["pool_address"], "block_number", ["k"])), "pool-prices")
    # one row for each pool and block
    ends = rows.filter("is_end").select("pool_address", "block_number", F.struct("k", "price", "growth").alias("end"))
    ends = lag_in_path(ends, "block_number", {"end": "prior"}, 10_000, by=["pool_address"])
    ends = lag_in_path(ends.withColumn("n", -F.col("block_number")), "n", {"end": "later"}, 10_000, by=["pool_address"]).drop("n")
    rows = rows.join(ends, ["pool_address", "block_number"])
    cells = [F.col("prior.price").alias("end_before"), F.when(F.col("is_end"), F.col("later")).otherwise(F.col("end")).alias("next_end")]
    return materialise(rows.select("pool_address", "k", "sec", "price", "before", "outside", "growth", "is_end", *cells), "pool-path")


def pool_curve(spark: SparkSession, d: str) -> DataFrame:
    """A daily rate curve over all days of the ledger; days without a rate have the last one before, or the first known."""
    day = lambda c: F.unix_date(c)
    span = table(spark, d, "pool_events").agg(F.to_date(F.min("block_timestamp")).alias("a"), F.to_date(F.max("block_timestamp")).alias("z")).filter("a IS NOT NULL")
    days = span.select(F.explode(F.sequence(day("a") - 1, day("z") + 2)).alias("n"))
    rates = table(spark, d, "portfolio_daily").filter("date IS NOT NULL").groupBy(day("date").alias("n")).agg(F.max("sofr_percent").alias("percent"))
    w = Window.orderBy("n")  # a calendar
    filled = days.join(rates, "n", "left").select(F.col("n").cast("bigint").alias("n"), F.last("percent", True).over(w).alias("p"), F.first("percent", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("q"))
    return rate_curve(filled.withColumn("percent", F.coalesce("p", "q", F.lit(0.0))), "n", "percent")


def life_costs(lives: DataFrame, key: list[str], path: DataFrame, entry: str, exit_: str) -> DataFrame:
    """Lives of positions with the pool's price before entry and exit and the costs of the path between them.

    lives: key, pool_address, low, high, liquidity, entry and exit as order keys. Adds ``p0``,
    ``p1``, ``swaps`` and the costs: ``lvr`` (rebalancing at the outside price), ``event`` (convexity
    of each swap) and ``block`` (convexity between the last prices of blocks), the latter two also
    discounted by the rate curve. The block mesh is the life's own: its first step starts at the
    entry price, its last may end inside the exit's block. These two steps are added to the sum
    over whole blocks. A life before its pool's first price has null prices and costs.
    """
    discount = F.exp(-F.col("growth"))
    one = F.lit(1.0)
    steps, measures = inventory_points({"lvr": (F.col("outside"), one), "event": (F.col("price"), one), "event_discounted": (F.col("price"), discount)})
    ends, end_measures = inventory_points({"block": (F.col("price"), one), "block_discounted": (F.col("price"), discount)}, before="end_before")
    every = [*measures, *end_measures]
    padded = lambda points, own: F.transform(F.coalesce(points, F.array().cast(_points_type(own))), lambda p: F.struct(p["at"].alias("at"), *[(p[m] if m in own else F.lit(0.0)).alias(m) for m in every]))
    points = F.concat(padded(steps, measures), padded(F.when(F.col("is_end"), ends), end_measures))
    sums = range_sums(lives, key, path, "k", points, every, entry, exit_, KEY_WIDTH, by="pool_address")
    unit = {c: inventory_cost(c) for c in COSTS}
    # tables of one row a life keep the expressions of each stage small
    rows = materialise(sums.select(*lives.columns, F.col("moves").alias("swaps"), *[u.alias(c) for c, u in unit.items()]), "life-sums")
    state = path.select("pool_address", F.col("k").alias("at"), F.struct("price", F.when(F.col("is_end"), F.col("price")).otherwise(F.col("end_before")).alias("last_end"), "next_end", "growth").alias("state"))
    for side, at in (("a", entry), ("z", exit_)):
        rows = asof_join(rows, state, at, "at", ["state"], KEY_WIDTH, by=["pool_address"]).drop("at_matched").withColumnRenamed("state", side)
    bounds = F.col("low"), F.col("high"), F.lit(1.0)
    rows = materialise(rows, "life-states")
    p0, p1, first = F.col("a.price"), F.col("z.price"), F.col("a.next_end")
    inside = F.coalesce(first["k"] < F.col(exit_), F.lit(False))
    step = convexity_cost(p0, first["price"], *bounds) - F.coalesce(convexity_cost(F.col("a.last_end"), first["price"], *bounds), F.lit(0.0))
    start = F.when(inside, F.col("z.last_end")).otherwise(p0)
    tail = convexity_cost(start, p1, *bounds)
    rows = rows.withColumns({"__step": step, "__tail": tail, "__inside": inside, "__p0": p0, "__p1": p1, "__da": F.exp(-first["growth"]), "__dz": F.exp(-F.col("z.growth"))})
    step, tail, inside = (F.col(f"__{n}") for n in ("step", "tail", "inside"))
    fixed = {
        "block": F.when(inside, F.col("block") + step).otherwise(0.0) + tail,
        "block_discounted": F.when(inside, F.col("block_discounted") + step * F.col("__da")).otherwise(0.0) + tail * F.col("__dz"),
    }
    # differences of sums may miss 0 by rounding; only the rebalancing cost may be negative
    cost = lambda c: fixed.get(c, F.col(c)) if c == "lvr" else F.greatest(fixed.get(c, F.col(c)), F.lit(0.0))
    out = rows.select(*lives.columns, "swaps", F.col("__p0").alias("p0"), F.col("__p1").alias("p1"), *[F.when(F.col("__p0").isNotNull(), F.col("liquidity") * cost(c)).alias(c) for c in COSTS])
    return materialise(out, "life-costs")


def _points_type(measures: list[str]) -> str:
    return f"array<struct<at:double,{','.join(f'{m}:double' for m in measures)}>>"


def risk_positions(spark: SparkSession, d: str, prices: DataFrame | None = None) -> DataFrame:
    """Pairs that hold for later blocks and whose ranges, amounts and prices are known, with bounds as prices."""
    p = pool_pairs(spark, d).filter("entry_block_number < exit_block_number AND entry_sec < exit_sec AND liquidity_raw > 0 AND tick_lower < tick_upper AND pool_address IS NOT NULL")
    p = _priced(spark, d, p.select("operation_id", "pool_address", "tick_lower", "tick_upper", "liquidity_raw", *[f"{s}_{c}" for s in ("entry", "exit") for c in ("key", "sec", "amount0_raw", "amount1_raw")]), prices)
    amount = lambda s, i: F.col(f"{s}_amount{i}_raw").cast("double") / F.lit(10.0 ** DECIMALS[i])
    p = p.withColumns({"low": tick_price(F.col("tick_lower")), "high": tick_price(F.col("tick_upper")), "liquidity": human_liquidity(F.col("liquidity_raw")), **{f"{n}{i}": amount(s, i) for s, n in (("entry", "d"), ("exit", "w")) for i in (0, 1)}})
    p = p.withColumns({"initial": F.col("d0") * F.col("entry_price") + F.col("d1"), "principal": F.col("w0") * F.col("exit_price") + F.col("w1"), "hold": F.col("d0") * F.col("exit_price") + F.col("d1")})
    kept = ["operation_id", "pool_address", "entry_key", "exit_key", "entry_sec", "exit_sec", "low", "high", "liquidity", "d0", "d1", "w0", "w1", "entry_price", "exit_price", "entry_price_second", "exit_price_second", "initial", "principal", "hold"]
    return p.filter("initial > 0 AND hold > 0 AND principal IS NOT NULL").select(*kept)


def lifetime_risk(spark: SparkSession, d: str) -> DataFrame:
    """Lifetime measures of each position: 22 columns and 5 further ratios, unrounded."""
    path, curve = pool_path(spark, d), pool_curve(spark, d)
    p = materialise(risk_positions(spark, d), "risk-positions")
    rows = with_growth(life_costs(p, ["operation_id"], path, "entry_key", "exit_key"), curve, "exit_sec", "growth").filter("p0 IS NOT NULL")
    bounds = F.col("low"), F.col("high"), F.col("liquidity")
    (x0, y0), (x1, y1) = (inventory(F.col(c), *bounds) for c in ("p0", "p1"))
    initial, loss = F.col("initial"), F.col("hold") - F.col("principal")

    def financed(cost: str, discounted: str) -> tuple[Column, Column]:
        """Opportunity cost and total; a rounding below 0 counts as none."""
        total = F.exp("growth") * F.col(discounted)
        gap = total - F.col(cost)
        noise = (gap < 0) & (F.abs(gap) <= 1e-10 * F.greatest(F.col(cost), F.lit(1.0)))
        return F.when(noise, 0.0).otherwise(gap), F.when(noise, F.col(cost)).otherwise(total)

    (opportunity, total), (event_opportunity, event_total) = financed("block", "block_discounted"), financed("event", "event_discounted")
    cells = {
        "pool_price_entry_usdt": F.col("p0"), "pool_price_exit_usdt": F.col("p1"),
        "theoretical_entry_weth": x0, "theoretical_entry_usdt": y0, "theoretical_exit_weth": x1, "theoretical_exit_usdt": y1,
        "entry_inventory_reconciliation_usdt": (x0 - F.col("d0")) * F.col("entry_price") + y0 - F.col("d1"),
        "exit_inventory_reconciliation_usdt": (x1 - F.col("w0")) * F.col("exit_price") + y1 - F.col("w1"),
        "il_signed_vs_hodl": -loss / F.col("hold"), "il_loss_usdt": loss, "il_loss_on_initial": loss / initial,
        "lvr_rebalancing_usdt": F.col("lvr"), "lvr_rebalancing_on_initial": F.col("lvr") / initial,
        "pl_convexity_cost_usdt": F.col("block"), "pl_opportunity_cost_usdt": opportunity, "pl_loss_usdt": total, "pl_signed_usdt": -total, "pl_loss_on_initial": total / initial,
        "pl_swap_event_convexity_cost_usdt": F.col("event"), "pl_swap_event_opportunity_cost_usdt": event_opportunity, "pl_swap_event_loss_usdt": event_total, "pl_swap_event_loss_on_initial": event_total / initial,
        "pl_signed_on_initial": -total / initial, "pl_convexity_cost_on_initial": F.col("block") / initial, "pl_opportunity_cost_on_initial": opportunity / initial,
        "pl_swap_event_convexity_cost_on_initial": F.col("event") / initial, "pl_swap_event_opportunity_cost_on_initial": event_opportunity / initial,
    }
    return rows.select("operation_id", "pool_address", "entry_sec", "exit_sec", "entry_price_second", "exit_price_second", "swaps", F.col("initial").alias("initial_wealth_usdt"), "liquidity", *[c.alias(n) for n, c in cells.items()])


#: Measures by the scale to which they are exact: inventories and path sums cancel at the size of the liquidity.
_BY_LIQUIDITY = ("theoretical", "entry_inventory", "exit_inventory", "lvr", "pl_")


def position_risk(spark: SparkSession, d: str) -> DataFrame:
    """The lifetime measures, rounded to a millionth of the liquidity, or of the initial wealth where no path is summed."""
    rows = lifetime_risk(spark, d)
    initial, size, out = F.col("initial_wealth_usdt"), F.col("liquidity"), []
    for c in rows.columns[9:]:
        if c.startswith(_BY_LIQUIDITY):
            part = (F.round(F.col(c) * initial / size, 6) * size / initial) if c.endswith("_on_initial") else F.round(F.col(c) / size, 6) * size
        else:
            part = F.round(F.col(c) / initial, 7) * initial if c == "il_loss_usdt" else F.round(c, 7)
        out.append(part.alias(c))
    return rows.select("operation_id", "swaps", F.round(initial, 4).alias("initial_wealth_usdt"), *out)


def _panel(rows: DataFrame) -> DataFrame:
    """The cells of the panel from the costs and states of positions and days."""
    x, y = inventory(F.coalesce("p1", "p0"), F.col("low"), F.col("high"), F.col("liquidity"))
    value = F.when(F.col("is_terminal"), F.col("w0") * F.col("outside") + F.col("w1")).otherwise(x * F.col("outside") + y)
    hold = F.col("d0") * F.col("outside") + F.col("d1")
    total, event_total = F.exp("growth") * F.col("block_discounted"), F.exp("growth") * F.col("event_discounted")
    cells = {"il_loss_usdt": hold - value, "lvr_rebalancing_usdt": F.col("lvr"), "pl_convexity_cost_usdt": F.col("block"), "pl_opportunity_cost_usdt": total - F.col("block"), "pl_loss_usdt": total, "pl_swap_event_convexity_cost_usdt": F.col("event"), "pl_swap_event_opportunity_cost_usdt": event_total - F.col("event"), "pl_swap_event_loss_usdt": event_total}
    return rows.select("operation_id", "day", "is_terminal", "swaps", F.col("outside").alias("external_price_usdt"), value.alias("lp_value_usdt"), hold.alias("hodl_value_usdt"), F.col("initial").alias("initial_capital_usdt"), "liquidity", *[c.alias(n) for n, c in cells.items()])


def _days_by_life(p: DataFrame, path: DataFrame, outside: DataFrame, curve: DataFrame) -> DataFrame:
    """Costs and states of positions and days with each as a life of its own, whatever the order of the path's times."""
    days = p.withColumn("day", F.explode(F.expr(f"sequence(entry_sec div {DAY}, (exit_sec - 1) div {DAY})")))
    days = days.withColumn("snapshot", F.least(F.col("exit_sec"), (F.col("day") + 1) * DAY)).withColumn("is_terminal", F.col("snapshot") == F.col("exit_sec"))
    # before the exit, a day's swaps are those before its end
    times = path.groupBy("pool_address", "sec").agg(F.max("k").alias("last_k"))
    days = asof_join(days, times, "snapshot", "sec", ["last_k"], SECONDS_WIDTH, by=["pool_address"]).drop("sec_matched")
    days = asof_join(days, outside, "snapshot", "second", ["outside"], SECONDS_WIDTH).drop("second_matched")
    days = days.withColumn("until", F.when(F.col("is_terminal"), F.col("exit_key")).otherwise(F.greatest(F.col("last_k") + 1, F.col("entry_key"))))
    rows = life_costs(materialise(days, "risk-days"), ["operation_id", "day"], path, "entry_key", "until").filter("p0 IS NOT NULL")
    return with_growth(rows, curve, "snapshot", "growth")


#: Days whose running costs are kept in one row a bound; fits the bits of a bigint.
SPAN = 32
#: For each cost the column of the price a move starts from, that of its amounts, and whether it is discounted.
MOVES = {"lvr": ("before", "outside", False), "event": ("before", "price", False), "event_discounted": ("before", "price", True), "block": ("end_before", "price", False), "block_discounted": ("end_before", "price", True)}


def _move_cost(c: str) -> Column:
    """What one move costs a liquidity of 1 between ``low`` and ``high``; nothing where the move has no price before it."""
    before, at, discounted = MOVES[c]
    (x0, y0), (x1, y1) = (inventory(F.col(n), F.col("low"), F.col("high"), F.lit(1.0)) for n in (before, "price"))
    cost = -(F.col(at) * (x1 - x0) + y1 - y0) * (F.exp(-F.col("growth")) if discounted else F.lit(1.0))
    return F.when(F.col(before).isNotNull() & (F.col("is_end") if before == "end_before" else F.lit(True)), cost)


def _bound_days(asked: DataFrame, path: DataFrame) -> DataFrame:
    """Asked pools, bounds and days with the state of the pool at the day's end and, for each cost, what all moves of the
    asked days up to it cost below the bound: the cost between two bounds is the difference of theirs.

    Days on which the pool does not move have the row before them, and none of their own unless they are the first of a span.
    """
    bare = lambda before: [F.struct(F.col(n).cast("double").alias("at"), F.lit(sign).alias("sign"), F.lit(before == "end_before").alias("end")) for n, sign in (("price", 1.0), (before, -1.0))]
    steps = F.when(F.col("before").isNotNull(), F.array(*bare("before")))
    ends = F.when(F.col("is_end") & F.col("end_before").isNotNull(), F.array(*bare("end_before")))
    none = F.array().cast("array<struct<at:double,sign:double,end:boolean>>")
    points = path.select("pool", "day", "state", "price", "outside", "growth", F.explode_outer(F.concat(F.coalesce(steps, none), F.coalesce(ends, none))).alias("p")).select("*", "p.*")
    root, cells = F.sqrt("at"), {}
    for n, (c, (before, at, discounted)) in enumerate(MOVES.items()):
        weight = F.when(F.col("end") == (before == "end_before"), F.col("sign") * (F.exp(-F.col("growth")) if discounted else F.lit(1.0)))
        cells |= {f"u{n}": weight * (F.col(at) / root + root), f"x{n}": weight * F.col(at), f"y{n}": weight}
    points = points.select("pool", "day", "at", F.lit(1).alias("order"), "state", F.when(F.col("at").isNotNull(), 1).alias("c"), *[v.alias(n) for n, v in cells.items()])
    rows = points.unionByName(asked.select("pool", "day", F.col("bound").alias("at"), F.lit(0).alias("order")), allowMissingColumns=True)
    whole = Window.partitionBy("pool", "day")
    below = whole.orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("pool", "day", "at", "order", F.max("state").over(whole).alias("state"), F.sum("c").over(whole).alias("all"), F.sum("c").over(below).alias("c"), *[F.coalesce(F.sum(n).over(below), F.lit(0.0)).alias(n) for n in cells]).filter("order = 0")
    # where no price of the day reaches the bound, what rounding leaves must not meet a bound far away
    reached = F.coalesce(F.col("c") < F.col("all"), F.lit(False))
    part = lambda n: F.when(reached, F.col(f"x{n}") / F.sqrt("at") + F.col(f"y{n}") * F.sqrt("at")).otherwise(0.0)
    rows = rows.select("pool", F.col("at").alias("bound"), "day", "state", *[(part(n) - F.col(f"u{n}")).alias(c) for n, c in enumerate(MOVES)])
    series = Window.partitionBy("pool", "bound").orderBy("day")
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    span = F.call_function("div", F.col("day"), F.lit(SPAN).cast("bigint"))
    rows = rows.withColumn("kept", F.col("state").isNotNull() | F.coalesce(F.lag(span).over(series) != span, F.lit(True)))
    return rows.select("pool", "bound", "day", "kept", F.last("state", True).over(upto).alias("state"), *[F.sum(c).over(upto).alias(c) for c in MOVES]).filter("kept").drop("kept")


def risk_days(spark: SparkSession, d: str) -> DataFrame:
    """One row for each position and day it is open: values and costs up to the day's end or the exit.

    A position meets the moves of the days of its entry and its exit only. What the days between
    cost is the difference of running costs by pool, bound and day, which positions of the same
    bounds share; they are looked up by spans of days, and positions become days at last.
    """
    prices = materialise(price_logs(spark, d), "price-logs")
    outside = materialise(market(spark, d, prices), "market")
    path, curve = pool_path(spark, d, prices, outside), pool_curve(spark, d)
    p = materialise(risk_positions(spark, d, outside), "risk-positions")
    path = running_sums(path, "k", [], {"i": F.lit(1)}, KEY_WIDTH, by=["pool_address"])
    path = path.withColumn("state", F.struct("k", "price", F.when(F.col("is_end"), F.col("price")).otherwise(F.col("end_before")).alias("last_end"), "growth", "i", F.expr(f"sec div {DAY}").alias("day"), "next_end", "sec"))
    path = materialise(lag_in_path(path, "k", {"state": "prior"}, KEY_WIDTH, by=["pool_address"]), "pool-states")
    odd = materialise(path.filter(F.col("sec") < F.col("prior.sec")).select("pool_address").distinct(), "odd-pools")
    if odd.isEmpty():
        return _panel(_days_by_bound(p, path, outside, curve))
    apart = _days_by_life(p.join(odd, "pool_address", "left_semi"), path.join(odd, "pool_address", "left_semi").drop("i", "state", "prior"), outside, curve)
    rest = _days_by_bound(p.join(odd, "pool_address", "left_anti"), path.join(odd, "pool_address", "left_anti"), outside, curve)
    return _panel(apart).unionByName(_panel(rest))


def _days_by_bound(p: DataFrame, path: DataFrame, outside: DataFrame, curve: DataFrame) -> DataFrame:
    """Costs and states of positions and days from running costs by bound; each pool's times must follow its order."""
    pools = path.select("pool_address").distinct().select("pool_address", F.row_number().over(Window.orderBy("pool_address")).alias("pool"))
    pools = materialise(pools, "pools")
    states = path.select("pool_address", F.col("k").alias("at"), F.struct("state", "prior").alias("found"))
    bounds = F.col("low"), F.col("high"), F.lit(1.0)
    # "a" is the pool's state before the entry, "e" that at it, "z" that before the exit
    p = asof_join(p.withColumn("at_entry", F.col("entry_key") + 1), states, "at_entry", "at", ["found"], KEY_WIDTH, by=["pool_address"]).drop("at_matched", "at_entry")
    p = p.withColumns({"a": F.when(F.col("found.state.k") == F.col("entry_key"), F.col("found.prior")).otherwise(F.col("found.state")), "e_i": F.col("found.state.i"), "e_day": F.col("found.state.day")}).drop("found").filter("a.price IS NOT NULL")
    p = asof_join(p, states, "exit_key", "at", ["found"], KEY_WIDTH, by=["pool_address"]).drop("at_matched").withColumn("z", F.col("found.state")).drop("found")
    first = F.col("a.next_end")
    step = convexity_cost(F.col("a.price"), first["price"], *bounds) - F.coalesce(convexity_cost(F.col("a.last_end"), first["price"], *bounds), F.lit(0.0))
    p = with_growth(p.join(pools, "pool_address"), curve, "exit_sec", "exit_growth")
    p = p.withColumns({"p0": F.col("a.price"), "first_k": first["k"], "step": step, "step_discounted": step * F.exp(-first["growth"]), "entry_day": F.expr(f"entry_sec div {DAY}"), "exit_day": F.expr(f"(exit_sec - 1) div {DAY}"), "moved": F.col("z.i") > F.col("e_i"), "n": F.monotonically_increasing_id()})
    z = ["k", "price", "last_end", "growth", "i", "day"]
    p = p.withColumn("z", F.struct(*[F.col(f"z.{c}").alias(c) for c in z]))
    p = materialise(p.select("n", "pool", "operation_id", "low", "high", "liquidity", "d0", "d1", "w0", "w1", "initial", "entry_key", "exit_key", "exit_price", "exit_growth", "entry_day", "exit_day", "e_i", "e_day", "p0", "first_k", "step", "step_discounted", "moved", "z"), "risk-states")
    moves = path.join(pools, "pool_address").select("pool", F.expr(f"sec div {DAY}").alias("day"), "k", "price", "before", "outside", "growth", "is_end", "end_before", F.struct(*[F.col(f"state.{c}").alias(c) for c in z[:-1]]).alias("state"))
    moves = materialise(moves, "pool-moves")

    # the days asked of each bound, by spans: a bit for each day
    both = F.explode(F.array("low", "high")).alias("bound")
    since, until = F.least("entry_day", "e_day"), F.greatest("exit_day", "z.day")
    spans = p.select("pool", both, since.alias("since"), until.alias("until"), F.explode(F.sequence(F.call_function("div", since, F.lit(SPAN).cast("bigint")), F.call_function("div", until, F.lit(SPAN).cast("bigint")))).alias("w"))
    bits = F.expr(f"shiftleft(shiftleft(1L, cast(least(until, w * {SPAN} + {SPAN - 1}) - greatest(since, w * {SPAN}) + 1 AS int)) - 1, cast(greatest(since, w * {SPAN}) - w * {SPAN} AS int))")
    asked = spans.groupBy("pool", "bound", "w").agg(F.bit_or(bits).alias("bits"))
    asked = asked.select("pool", "bound", F.explode(F.filter(F.sequence(F.col("w") * SPAN, F.col("w") * SPAN + SPAN - 1), lambda day: F.call_function("shiftright", F.col("bits"), (day - F.col("w") * SPAN).cast("int")).bitwiseAND(F.lit(1)) == 1)).alias("day"))
    running = materialise(_bound_days(asked, moves), "bound-days")

    # costs of the first day from the entry on, of all days up to the entry's and up to the exit's, and of the last day from the
    # exit on, which is taken off; within one day, of the moves between
    one_day = F.col("z.day") == F.col("e_day")
    sides = [("start", "e_day", "entry_key", F.lit(2**62)), ("end", "z.day", F.when(one_day, F.col("entry_key")).otherwise(F.col("exit_key") - 1), F.when(one_day, F.col("exit_key")).otherwise(F.lit(2**62)))]
    lives = F.explode(F.array(*[F.struct(F.lit(name).alias("part"), F.col(day).alias("day"), (F.col(a) if isinstance(a, str) else a).alias("a"), (F.col(b) if isinstance(b, str) else b.cast("bigint")).alias("b")) for name, day, a, b in sides])).alias("s")
    met = p.filter("moved").select("n", "pool", "low", "high", one_day.alias("one_day"), lives).select("n", "pool", "low", "high", "one_day", "s.*").join(moves, ["pool", "day"]).filter("k > a AND k < b")
    sign = F.when((F.col("part") == "end") & ~F.col("one_day"), -1.0).otherwise(1.0)
    met = met.select("n", "part", *[(sign * _move_cost(c)).alias(c) for c in MOVES])
    probes = [(name, F.col(b), day, sign * s) for name, day, sign in (("start", F.col("e_day"), -1), ("end", F.when(F.col("moved") & ~one_day, F.col("z.day")), 1)) for b, s in (("high", 1.0), ("low", -1.0))]
    looks = F.explode(F.array(*[F.struct(F.lit(name).alias("part"), b.alias("bound"), day.alias("day"), F.lit(sign).alias("sign")) for name, b, day, sign in probes])).alias("s")
    found = p.select("n", "pool", looks).select("n", "pool", "s.*").join(running.drop("state"), ["pool", "bound", "day"]).select("n", "part", *[(F.col("sign") * F.col(c)).alias(c) for c in MOVES])
    sums = met.unionByName(found).groupBy("n").agg(*[F.coalesce(F.sum(F.when(F.col("part") == part, F.col(c))), F.lit(0.0)).alias(f"{part}_{c}") for part in ("start", "end") for c in MOVES])
    p = materialise(p.join(sums, "n"), "risk-sums")

    def told(rows: DataFrame, state: str, cost: dict[str, Column]) -> DataFrame:
        """Costs with the two steps of a life's own mesh of blocks, for its liquidity."""
        inside = F.coalesce(F.col("first_k") <= F.col(f"{state}.k"), F.lit(False))
        tail = convexity_cost(F.when(inside, F.col(f"{state}.last_end")).otherwise(F.col("p0")), F.col(f"{state}.price"), *bounds)
        cost = cost | {"block": F.when(inside, cost["block"] + F.col("step")).otherwise(0.0) + tail, "block_discounted": F.when(inside, cost["block_discounted"] + F.col("step_discounted")).otherwise(0.0) + tail * F.exp(-F.col(f"{state}.growth"))}
        # differences of sums may miss 0 by rounding; only the rebalancing cost may be negative
        return rows.withColumns({c: F.col("liquidity") * (v if c == "lvr" else F.greatest(v, F.lit(0.0))) for c, v in cost.items()})

    kept = ["operation_id", "day", "is_terminal", "swaps", "outside", "growth", "p0", "p1", "low", "high", "liquidity", "d0", "d1", "w0", "w1", "initial", *MOVES]
    none = F.lit(0.0)
    at_exit = {c: F.when(F.col("moved"), F.when(F.col("z.day") == F.col("e_day"), F.col(f"end_{c}")).otherwise(F.col(f"start_{c}") + F.col(f"end_{c}"))).otherwise(none) for c in MOVES}
    last = told(p, "z", at_exit).withColumns({"day": F.col("exit_day"), "is_terminal": F.lit(True), "swaps": F.greatest(F.col("z.i") - F.col("e_i"), F.lit(0)).cast("bigint"), "outside": F.col("exit_price"), "growth": F.col("exit_growth"), "p1": F.col("z.price")}).select(*kept)

    # the days before, by spans
    calendar = p.agg(F.min("entry_day").alias("a"), F.max("exit_day").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day")).withColumn("snapshot", (F.col("day") + 1) * DAY)
    calendar = with_growth(asof_join(calendar, outside, "snapshot", "second", ["outside"], SECONDS_WIDTH).drop("second_matched"), curve, "snapshot", "growth").select("day", "outside", "growth")
    listed = lambda rows, cells: rows.groupBy("pool", "bound", F.call_function("div", F.col("day"), F.lit(SPAN).cast("bigint")).alias("w")).agg(F.sort_array(F.collect_list(F.struct("day", F.struct(*cells).alias("v")))).alias("l"))
    open_ = p.filter("entry_day < exit_day").select("pool", "operation_id", "low", "high", "liquidity", "d0", "d1", "initial", "entry_key", "entry_day", "exit_day", "e_i", "p0", "first_k", "step", "step_discounted", *[f"start_{c}" for c in MOVES], F.explode(F.sequence(F.call_function("div", F.col("entry_day"), F.lit(SPAN).cast("bigint")), F.call_function("div", F.col("exit_day") - 1, F.lit(SPAN).cast("bigint")))).alias("w"))
    open_ = open_.withColumns({"since": F.greatest(F.col("entry_day"), F.col("w") * SPAN), "until": F.least(F.col("exit_day") - 1, F.col("w") * SPAN + SPAN - 1)}).drop("entry_day", "exit_day")
    # of a span, the rows from the last at or before the first day on
    own = F.filter("l", lambda x, i: (x["day"] <= F.col("until")) & (F.coalesce(F.get("l", i + 1)["day"], F.col("until") + 1) > F.col("since")))
    lows, highs = (listed(running, cells).withColumnRenamed("bound", side) for side, cells in (("low", list(MOVES)), ("high", [*MOVES, "state"])))
    open_ = open_.join(lows, ["pool", "low", "w"]).withColumn("lows", own).drop("l")
    open_ = open_.join(highs, ["pool", "high", "w"]).withColumn("day", F.explode(F.sequence("since", "until")))
    upto = lambda rows: F.element_at(F.filter(rows, lambda x: x["day"] <= F.col("day")), -1)["v"]
    open_ = open_.withColumns({"v": upto("l"), "u": upto("lows")}).drop("l", "lows").join(calendar, "day", "left")
    open_ = open_.withColumn("seen", F.coalesce(F.col("v.state.k") >= F.col("entry_key"), F.lit(False)))
    # until the pool moves after the entry, its state is that of the entry
    open_ = open_.withColumn("s", F.col("v.state"))
    cost = {c: F.when(F.col("seen"), F.col(f"start_{c}") + F.col(f"v.{c}") - F.col(f"u.{c}")).otherwise(none) for c in MOVES}
    days = told(open_, "s", cost).withColumns({c: F.when(F.col("seen"), F.col(c)).otherwise(none) for c in MOVES})
    days = days.withColumns({"is_terminal": F.lit(False), "swaps": F.when(F.col("seen"), F.col("s.i") - F.col("e_i")).otherwise(0).cast("bigint"), "p1": F.when(F.col("seen"), F.col("s.price")).otherwise(F.col("p0")), "w0": F.lit(None).cast("double"), "w1": F.lit(None).cast("double")})
    return days.select(*kept).unionByName(last)


DAILY = ("il_loss_usdt", "lvr_rebalancing_usdt", "pl_convexity_cost_usdt", "pl_opportunity_cost_usdt", "pl_loss_usdt", "pl_swap_event_convexity_cost_usdt", "pl_swap_event_opportunity_cost_usdt", "pl_swap_event_loss_usdt")


def position_day_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel of positions and days, rounded to a millionth of the liquidity, or of the capital where no path is summed."""
    rows, capital, size = risk_days(spark, d), F.col("initial_capital_usdt"), F.col("liquidity")
    scale = {c: size for c in DAILY} | {c: F.when(F.col("is_terminal"), capital).otherwise(size) for c in ("lp_value_usdt", "il_loss_usdt")} | {"hodl_value_usdt": capital}
    money = ("lp_value_usdt", "hodl_value_usdt", *DAILY)
    return rows.select("operation_id", "day", "is_terminal", "swaps", r6("external_price_usdt").alias("external_price_usdt"), F.round(capital, 4).alias("initial_capital_usdt"), *[(F.round(F.col(c) / scale[c], 6) * scale[c]).alias(c) for c in money])


def portfolio_panel(spark: SparkSession, d: str) -> DataFrame:
    """Open positions by day: count, capital, eight sums and eight ratios weighted by capital, the day's close and rate.

    Sums are told per unit of the day's liquidity, to whose size they are exact.
    """
    sums = risk_days(spark, d).groupBy("day").agg(F.count("*").alias("position_day_count"), F.sum("initial_capital_usdt").alias("capital"), F.sum("liquidity").alias("liquidity"), *[F.sum(c).alias(c) for c in DAILY])
    # the close is the last price before the next day
    sums = asof_join(sums.withColumn("next", (F.col("day") + 1) * DAY), market(spark, d), "next", "second", ["outside"], SECONDS_WIDTH).withColumnRenamed("outside", "ethusdt_close")
    rates = pool_curve(spark, d).select(F.col("day_number").alias("day"), (F.expm1("log_rate") * 36_000).alias("sofr_percent"))
    each, weight = {c: F.round(F.col(c) / F.col("liquidity"), 6) for c in DAILY}, F.round(F.col("liquidity") / F.col("capital"), 3)
    ratio = {c: "capital_weighted_" + c.replace("_rebalancing_usdt", "_loss_pct").replace("_usdt", "_pct") for c in DAILY}
    return sums.join(rates, "day", "left").select("day", "position_day_count", F.round("capital", 2).alias("initial_capital_usdt"), *[v.alias(c.replace("_usdt", "_per_liquidity")) for c, v in each.items()], *[(100 * each[c] * weight).alias(n) for c, n in ratio.items()], r6("ethusdt_close").alias("ethusdt_close"), r6("sofr_percent").alias("sofr_percent"))


def identity_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the lifetime measures, their prices and the cohorts of pairs must keep, one row each."""
    rows = materialise(lifetime_risk(spark, d), "lifetime-risk")
    measures = rows.columns[10:]
    close = lambda a, b: F.abs(F.col(a) - b) <= 1e-10 + 1e-12 * F.abs(b)
    finite = F.lit(True)
    for c in measures:
        finite &= ~F.isnan(c) & (F.abs(c) != float("inf"))
    initial = F.col("initial_wealth_usdt")
    rules = {
        "measures_finite": finite, "convexity_not_negative": (F.col("pl_convexity_cost_usdt") >= 0) & (F.col("pl_swap_event_convexity_cost_usdt") >= 0),
        "loss_is_convexity_and_opportunity": close("pl_loss_usdt", F.col("pl_convexity_cost_usdt") + F.col("pl_opportunity_cost_usdt")) | (F.abs(F.col("pl_loss_usdt") - F.col("pl_convexity_cost_usdt") - F.col("pl_opportunity_cost_usdt")) <= 1e-12 * F.col("pl_loss_usdt")),
        "signed_is_negative_loss": F.col("pl_signed_usdt") == -F.col("pl_loss_usdt"), "ratios_are_of_initial_wealth": close("pl_loss_on_initial", F.col("pl_loss_usdt") / initial) & close("il_loss_on_initial", F.col("il_loss_usdt") / initial),
        "prices_known_before_the_event": (F.col("entry_price_second") < F.col("entry_sec")) & (F.col("exit_price_second") < F.col("exit_sec")), "entry_before_exit": F.col("entry_sec") < F.col("exit_sec"),
    }
    p = pool_pairs(spark, d).filter("entry_key IS NOT NULL AND exit_key IS NOT NULL")
    cohort = F.when(F.col("entry_block_number") == F.col("exit_block_number"), "same_block").when(F.col("entry_block_number") < F.col("exit_block_number"), "multi_block").when(F.col("entry_block_number") > F.col("exit_block_number"), "reversed")
    logs = standing_logs(spark, d)
    return together([count_violations(rows, rules), repeated_keys(rows, ["operation_id"], "operation_once"), count_violations(p, {"cohorts_partition_pairs": cohort.isNotNull()}), repeated_keys(logs, LOG, "standing_log_once")])


QUERIES = {f.__name__: f for f in (identity_violations, decoded_events, pair_fees, position_returns, closed_position_returns, position_risk, position_day_panel, portfolio_panel)}


def _int(c: str) -> str:
    return f"CASE WHEN regexp_full_match(regexp_replace({c}, '\\s+', '', 'g'), '[+-]?0*[0-9]{{1,38}}') THEN replace(regexp_replace({c}, '\\s+', '', 'g'), '+', '')::HUGEINT END AS {c}"


_KEYED = "{0}block_number * 10000000000 + {0}transaction_index * 100000 + {0}log_index"
_LOGS = f"""logs AS (SELECT *, {_KEYED.format('')} AS k FROM (
  SELECT block_number, lower(trim(transaction_hash)) AS transaction_hash, log_index, transaction_index, floor(epoch(block_timestamp))::BIGINT AS sec, lower(trim(address)) AS address, lower(trim(event_type)) AS kind,
    lower(trim(sender)) AS sender, lower(trim(owner)) AS owner, lower(trim(recipient)) AS recipient, tick_lower, tick_upper, tick, {', '.join(_int(c) for c in ('liquidity_delta_raw', 'amount0_raw', 'amount1_raw', 'sqrt_price_x96', 'active_liquidity_raw'))}, coalesce(removed, false) AS gone, ingested_at
  FROM pool_events) QUALIFY row_number() OVER (PARTITION BY block_number, transaction_hash, log_index ORDER BY ingested_at DESC NULLS LAST, gone DESC, {', '.join(f'{c} DESC NULLS LAST' for c in ('sec', 'transaction_index', 'address', 'kind', 'sender', 'owner', 'recipient', 'tick_lower', 'tick_upper', 'tick', 'liquidity_delta_raw', 'amount0_raw', 'amount1_raw', 'sqrt_price_x96', 'active_liquidity_raw'))}) = 1)"""
_PAIRS = f"""pp AS (SELECT *, {_KEYED.format('entry_')} AS entry_key, {_KEYED.format('exit_')} AS exit_key FROM (
  SELECT lower(trim(operation_id)) AS operation_id, lower(trim(pool_address)) AS pool, lower(trim(manager_address)) AS manager, lower(trim(lp_wallet)) AS wallet, tick_lower, tick_upper, {_int('liquidity_raw')}, trim(nfpm_token_id) AS token_id, nfpm_token_id_consistent AS told,
    {', '.join(f'{s}_{c}' for s in ('entry', 'exit') for c in ('block_number', 'transaction_index', 'log_index'))}, {', '.join(f'lower(trim({s}_transaction_hash)) AS {s}_hash, floor(epoch({s}_block_timestamp))::BIGINT AS {s}_sec' for s in ('entry', 'exit'))}, {', '.join(_int(f'{s}_amount{i}_raw') for s in ('entry', 'exit') for i in (0, 1))}, holding_seconds
  FROM operation_pairs QUALIFY row_number() OVER (PARTITION BY lower(trim(operation_id)) ORDER BY built_at DESC NULLS LAST) = 1))"""
_BASE = f"WITH {_LOGS.replace('logs AS', 'newest AS', 1)}, logs AS (SELECT * FROM newest WHERE NOT gone), {_PAIRS}"  # of messages of one time the greatest values hold
_OUT = ("sender", "owner", "recipient", "from_address", "to_address", "tick_lower", "tick_upper", "tick", "token_id", "liquidity_delta_raw", "amount0_raw", "amount1_raw", "sqrt_price_x96", "active_liquidity_raw")


def _decoded(frame: str, kind: str, table_: str, at: str, cells: dict[str, str]) -> str:
    """Rows of one kind as they should come out: the columns of the table, text for integers of any size."""
    text = lambda c: f"({cells[c]})::VARCHAR AS {c}" if c in cells and c in _OUT[8:] else f"{cells[c]} AS {c}" if c in cells else f"NULL AS {c}"
    where = " AND ".join(f"{c} IS NOT NULL" for c in cells.values())
    return f"SELECT {at}, '{frame}' AS frame, '{kind}' AS event_type, {', '.join(map(text, _OUT))} FROM {table_} AND {where}"


_own = lambda *names: {c: c for c in names}
_AT = {s: f"{s}_block_number AS block_number, {s}_hash AS transaction_hash, {s}_transaction_index AS transaction_index, {s}_log_index AS log_index" for s in ("entry", "exit")}
_IN_POOL, _IN_PAIRS = "logs WHERE kind = '{}'", "pp WHERE regexp_full_match(token_id, '[0-9]+')"
_AMOUNTS = {s: {"amount0_raw": f"{s}_amount0_raw", "amount1_raw": f"{s}_amount1_raw", "token_id": "token_id::HUGEINT"} for s in ("entry", "exit")}
_PLACE = "block_number, transaction_hash, transaction_index, log_index"
_NINE = [
    _decoded("pool", "Initialize", _IN_POOL.format("initialize"), _PLACE, _own("sqrt_price_x96", "tick")),
    _decoded("pool", "Mint", _IN_POOL.format("mint"), _PLACE, _own("sender", "owner", "tick_lower", "tick_upper", "amount0_raw", "amount1_raw") | {"liquidity_delta_raw": "abs(liquidity_delta_raw)"}),
    _decoded("pool", "Burn", _IN_POOL.format("burn"), _PLACE, _own("owner", "tick_lower", "tick_upper", "amount0_raw", "amount1_raw") | {"liquidity_delta_raw": "-abs(liquidity_delta_raw)"}),
    _decoded("pool", "Swap", _IN_POOL.format("swap"), _PLACE, _own("sender", "recipient", "amount0_raw", "amount1_raw", "sqrt_price_x96", "active_liquidity_raw", "tick")),
    _decoded("pool", "Collect", _IN_POOL.format("collect"), _PLACE, _own("owner", "recipient", "tick_lower", "tick_upper", "amount0_raw", "amount1_raw")),
    _decoded("manager", "IncreaseLiquidity", _IN_PAIRS, _AT["entry"], _AMOUNTS["entry"] | {"liquidity_delta_raw": "liquidity_raw"}),
    _decoded("manager", "DecreaseLiquidity", _IN_PAIRS, _AT["exit"], _AMOUNTS["exit"] | {"liquidity_delta_raw": "-liquidity_raw"}),
    _decoded("manager", "Collect", _IN_PAIRS, _AT["exit"], _AMOUNTS["exit"] | {"recipient": "wallet"}),
    _decoded("manager", "Transfer", _IN_PAIRS, _AT["entry"], {"from_address": f"'{ZERO}'", "to_address": "wallet", "token_id": "token_id::HUGEINT"}),
]
_FEES = _BASE + """, q AS (SELECT * FROM pp WHERE entry_key < exit_key),
hits AS (SELECT q.operation_id, (c.block_number = q.exit_block_number AND c.transaction_index = q.exit_transaction_index) AS at_exit, c.k AS k, coalesce(c.amount0_raw, 0) AS a0, coalesce(c.amount1_raw, 0) AS a1
  FROM q LEFT JOIN logs c ON c.kind = 'collect' AND c.address = q.pool AND c.owner = q.manager AND c.tick_lower = q.tick_lower AND c.tick_upper = q.tick_upper AND ((c.k > q.entry_key AND (c.block_number, c.transaction_index) < (q.exit_block_number, q.exit_transaction_index))
    OR (c.block_number = q.exit_block_number AND c.transaction_index = q.exit_transaction_index AND c.log_index > q.exit_log_index AND c.k > q.exit_key))),
sums AS (SELECT operation_id, count(k) FILTER (WHERE NOT at_exit) AS interim_count, count(k) FILTER (WHERE at_exit) AS exit_count, coalesce(sum(a0) FILTER (WHERE NOT at_exit), 0) AS i0, coalesce(sum(a1) FILTER (WHERE NOT at_exit), 0) AS i1, coalesce(sum(a0) FILTER (WHERE at_exit), 0) AS e0, coalesce(sum(a1) FILTER (WHERE at_exit), 0) AS e1 FROM hits GROUP BY 1),
cover AS (SELECT q.*, sums.* EXCLUDE (operation_id), e0 >= coalesce(exit_amount0_raw, 0) AND e1 >= coalesce(exit_amount1_raw, 0) AS covers FROM q JOIN sums USING (operation_id)),
fees AS (SELECT *, i0 + CASE WHEN covers THEN e0 - coalesce(exit_amount0_raw, 0) ELSE 0 END AS fee0, i1 + CASE WHEN covers THEN e1 - coalesce(exit_amount1_raw, 0) ELSE 0 END AS fee1,
  NOT EXISTS (SELECT 1 FROM q b WHERE b.pool = cover.pool AND b.manager = cover.manager AND b.tick_lower = cover.tick_lower AND b.tick_upper = cover.tick_upper AND b.operation_id <> cover.operation_id AND b.entry_key < cover.exit_key AND cover.entry_key < b.exit_key) AS included FROM cover)"""
_MARKET = """, prices AS (SELECT *, (sqrt_price_x96::DOUBLE / 79228162514264337593543950336.0::DOUBLE) * (sqrt_price_x96::DOUBLE / 79228162514264337593543950336.0::DOUBLE) * 1e12::DOUBLE AS price FROM logs WHERE kind IN ('swap', 'initialize') AND sqrt_price_x96 > 0 AND sec IS NOT NULL),
market AS (SELECT sec, arg_max(price, (k, price)) AS outside FROM prices WHERE kind = 'swap' GROUP BY 1)"""


def _asof_prices(source: str) -> str:
    return f""", pe AS (SELECT t.*, m.outside AS entry_price FROM {source} t ASOF LEFT JOIN market m ON t.entry_sec > m.sec), priced AS (SELECT pe.*, m.outside AS exit_price FROM pe ASOF LEFT JOIN market m ON pe.exit_sec > m.sec)"""


def _values(fees: tuple[str, str]) -> str:
    d0, d1, w0, w1 = "entry_amount0_raw::DOUBLE / 1e18", "entry_amount1_raw::DOUBLE / 1e6", "exit_amount0_raw::DOUBLE / 1e18", "exit_amount1_raw::DOUBLE / 1e6"
    return f", v AS (SELECT *, {d0} AS d0, {d1} AS d1, {w0} AS w0, {w1} AS w1, {fees[0]}::DOUBLE / 1e18 AS f0, {fees[1]}::DOUBLE / 1e6 AS f1, d0 * entry_price + d1 AS initial, w0 * exit_price + w1 AS principal, f0 * exit_price + f1 AS fee, d0 * exit_price + d1 AS hold, principal + fee AS lp FROM priced)"


_B = ("low", "high", "liquidity")
_CURVE = """, span AS (SELECT (min(block_timestamp)::DATE - DATE '1970-01-01') - 1 AS a, (max(block_timestamp)::DATE - DATE '1970-01-01') + 2 AS z FROM pool_events), cal AS (SELECT unnest(generate_series(a, z)) AS n FROM span),
rates AS (SELECT date - DATE '1970-01-01' AS n, max(sofr_percent) AS percent FROM portfolio_daily WHERE date IS NOT NULL GROUP BY 1),
filled AS (SELECT cal.n, coalesce(last_value(percent IGNORE NULLS) OVER (ORDER BY cal.n), first_value(percent IGNORE NULLS) OVER (ORDER BY cal.n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS percent FROM cal LEFT JOIN rates ON rates.n = cal.n),
curve AS (SELECT n, percent, ln(1 + percent / 100 / 360) AS log_rate, coalesce(sum(ln(1 + percent / 100 / 360)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM filled)"""
_WALK = """, w0 AS (SELECT address AS pool, k, block_number, sec, price, CASE WHEN kind = 'swap' THEN lag(price) OVER (PARTITION BY address ORDER BY k) END AS before FROM prices WHERE k IS NOT NULL),
w1 AS (SELECT w0.*, coalesce(m.outside, before, price) AS outside FROM w0 ASOF LEFT JOIN market m ON w0.sec > m.sec),
walk AS (SELECT w1.*, start + log_rate * (sec % 86400) / 86400 AS growth FROM w1 LEFT JOIN curve ON n = sec // 86400)"""
_RISK = _BASE + _MARKET + _asof_prices("pp") + _values(("0", "0")) + """, risk AS (SELECT operation_id, pool, entry_key, exit_key, entry_sec, exit_sec, pow(1.0001::DOUBLE, tick_lower) * 1e12::DOUBLE AS low, pow(1.0001::DOUBLE, tick_upper) * 1e12::DOUBLE AS high, liquidity_raw::DOUBLE * 1e-12::DOUBLE AS liquidity, d0, d1, w0, w1, entry_price, exit_price, initial, principal, hold
  FROM v WHERE entry_block_number < exit_block_number AND entry_sec < exit_sec AND liquidity_raw > 0 AND tick_lower < tick_upper AND pool IS NOT NULL AND initial > 0 AND hold > 0 AND principal IS NOT NULL)""" + _CURVE + _WALK


def _life_sql(lives: str, key: str, until: str) -> str:
    """Costs of each life by meeting it with every price in it."""
    on = f"s.pool = v.pool AND s.k > v.entry_key AND s.k < v.{until}"
    by = ", ".join(f"v.{c.strip()}" for c in key.split(","))
    return f""", a0 AS (SELECT v.*, w.price AS p0 FROM {lives} v ASOF LEFT JOIN walk w ON v.pool = w.pool AND v.entry_key > w.k), a1 AS (SELECT v.*, w.price AS p1 FROM a0 v ASOF LEFT JOIN walk w ON v.pool = w.pool AND v.{until} > w.k),
swapped AS (SELECT {by}, count(*) AS swaps, sum({_step('s.before', 's.price', 's.outside', *_B)}) AS lvr, sum({_convex('s.before', 's.price', *_B)}) AS event, sum({_convex('s.before', 's.price', *_B)} * exp(-growth)) AS event_discounted FROM {lives} v JOIN walk s ON {on} GROUP BY {by}),
scope AS (SELECT {by}, any_value(v.p0) AS p0, any_value(low) AS low, any_value(high) AS high, any_value(liquidity) AS liquidity, s.block_number, arg_max(s.price, s.k) AS fin, max(s.k) AS k, any_value(s.growth) AS growth FROM a0 v JOIN walk s ON {on} GROUP BY {by}, s.block_number),
mesh AS (SELECT *, coalesce(lag(fin) OVER (PARTITION BY {key} ORDER BY k), p0) AS prev FROM scope),
blocked AS (SELECT {key}, sum({_convex('prev', 'fin', *_B)}) AS block, sum({_convex('prev', 'fin', *_B)} * exp(-growth)) AS block_discounted FROM mesh GROUP BY {key}),
lived AS (SELECT a1.*, coalesce(swaps, 0) AS swaps, coalesce(lvr, 0) AS lvr, coalesce(event, 0) AS event, coalesce(event_discounted, 0) AS event_discounted, coalesce(block, 0) AS block, coalesce(block_discounted, 0) AS block_discounted FROM a1 LEFT JOIN swapped USING ({key}) LEFT JOIN blocked USING ({key}) WHERE p0 IS NOT NULL)"""


def _grown(sec: str) -> str:
    return f"exp((SELECT start + log_rate * ({sec} % 86400) / 86400 FROM curve WHERE n = {sec} // 86400))"


_LIFE = _RISK + _life_sql("risk", "operation_id", "exit_key") + f""", total AS (SELECT *, {_grown('exit_sec')} * block_discounted AS pl0, {_grown('exit_sec')} * event_discounted AS ev0 FROM lived),
held AS (SELECT *, pl0 - block AS op0, ev0 - event AS eo0, op0 < 0 AND abs(op0) <= 1e-10 * greatest(block, 1) AS small, eo0 < 0 AND abs(eo0) <= 1e-10 * greatest(event, 1) AS small_event, CASE WHEN small THEN 0 ELSE op0 END AS opportunity, CASE WHEN small THEN block ELSE pl0 END AS loss, CASE WHEN small_event THEN 0 ELSE eo0 END AS event_opportunity, CASE WHEN small_event THEN event ELSE ev0 END AS event_loss FROM total)"""
_IL = "(hold - principal)"
_MEASURES = {
    "theoretical_entry_weth": (_x("p0", *_B), "liquidity"), "theoretical_entry_usdt": (_y("p0", *_B), "liquidity"), "theoretical_exit_weth": (_x("p1", *_B), "liquidity"), "theoretical_exit_usdt": (_y("p1", *_B), "liquidity"),
    "entry_inventory_reconciliation_usdt": (f"({_x('p0', *_B)} - d0) * entry_price + {_y('p0', *_B)} - d1", "liquidity"), "exit_inventory_reconciliation_usdt": (f"({_x('p1', *_B)} - w0) * exit_price + {_y('p1', *_B)} - w1", "liquidity"),
    "il_signed_vs_hodl": (f"-{_IL} / hold", ""), "il_loss_usdt": (_IL, "initial"), "il_loss_on_initial": (f"{_IL} / initial", ""), "lvr_rebalancing_usdt": ("lvr", "liquidity"), "lvr_rebalancing_on_initial": ("lvr", "ratio"),
    "pl_convexity_cost_usdt": ("block", "liquidity"), "pl_opportunity_cost_usdt": ("opportunity", "liquidity"), "pl_loss_usdt": ("loss", "liquidity"), "pl_signed_usdt": ("-loss", "liquidity"), "pl_loss_on_initial": ("loss", "ratio"),
    "pl_swap_event_convexity_cost_usdt": ("event", "liquidity"), "pl_swap_event_opportunity_cost_usdt": ("event_opportunity", "liquidity"), "pl_swap_event_loss_usdt": ("event_loss", "liquidity"), "pl_swap_event_loss_on_initial": ("event_loss", "ratio"),
    "pl_signed_on_initial": ("-loss", "ratio"), "pl_convexity_cost_on_initial": ("block", "ratio"), "pl_opportunity_cost_on_initial": ("opportunity", "ratio"), "pl_swap_event_convexity_cost_on_initial": ("event", "ratio"), "pl_swap_event_opportunity_cost_on_initial": ("event_opportunity", "ratio"),
    "pool_price_entry_usdt": ("p0", ""), "pool_price_exit_usdt": ("p1", ""),
}
_DAYS = _RISK + """, dd AS (SELECT risk.*, unnest(generate_series(entry_sec // 86400, (exit_sec - 1) // 86400)) AS day FROM risk), d1 AS (SELECT *, least(exit_sec, (day + 1) * 86400) AS snapshot FROM dd),
marks AS (SELECT pool, sec, max(k) AS last_k FROM walk GROUP BY 1, 2), d2 AS (SELECT d1.*, m.last_k FROM d1 ASOF LEFT JOIN marks m ON d1.pool = m.pool AND d1.snapshot > m.sec),
d3 AS (SELECT d2.*, m.outside FROM d2 ASOF LEFT JOIN market m ON d2.snapshot > m.sec), days AS (SELECT *, snapshot = exit_sec AS is_terminal, CASE WHEN snapshot = exit_sec THEN exit_key ELSE greatest(last_k + 1, entry_key) END AS until FROM d3)""" + _life_sql("days", "operation_id, day", "until") + f""",
panel0 AS (SELECT operation_id, day, is_terminal, swaps, outside AS external_price_usdt, initial AS initial_capital_usdt, liquidity, CASE WHEN is_terminal THEN w0 * outside + w1 ELSE {_x('coalesce(p1, p0)', *_B)} * outside + {_y('coalesce(p1, p0)', *_B)} END AS lp_value_usdt, d0 * outside + d1 AS hodl_value_usdt, hodl_value_usdt - lp_value_usdt AS il_loss_usdt, lvr AS lvr_rebalancing_usdt, block AS pl_convexity_cost_usdt,
  {_grown('snapshot')} * block_discounted AS pl_loss_usdt, event AS pl_swap_event_convexity_cost_usdt, {_grown('snapshot')} * event_discounted AS pl_swap_event_loss_usdt FROM lived),
panel AS (SELECT *, pl_loss_usdt - pl_convexity_cost_usdt AS pl_opportunity_cost_usdt, pl_swap_event_loss_usdt - pl_swap_event_convexity_cost_usdt AS pl_swap_event_opportunity_cost_usdt FROM panel0)"""
_RULES = ("measures_finite", "convexity_not_negative", "loss_is_convexity_and_opportunity", "signed_is_negative_loss", "ratios_are_of_initial_wealth", "prices_known_before_the_event", "entry_before_exit", "operation_once", "cohorts_partition_pairs", "standing_log_once")
SQL = {
    "identity_violations": " UNION ALL ".join(f"SELECT '{rule}' AS rule, 0::BIGINT AS violations" for rule in _RULES),
    "decoded_events": _BASE + " " + " UNION ALL ".join(_NINE),
    "pair_fees": _FEES + " SELECT operation_id, interim_count, exit_count, covers AS exit_covers_principal, fee0::VARCHAR AS realized_fee0_raw, fee1::VARCHAR AS realized_fee1_raw, included FROM fees",
    "position_returns": _FEES + _MARKET + _asof_prices("fees") + _values(("fee0", "fee1")) + """, r AS (SELECT *, included AND initial > 0 AND hold > 0 AS good, (lp - initial) / nullif(initial, 0) AS total, holding_seconds / 86400 AS days, CASE WHEN total > -1 AND days > 0 THEN ln(1 + total) / days END AS daily FROM v)
SELECT operation_id, included, CASE WHEN good THEN round(initial, 4) END AS initial_wealth_usdt, CASE WHEN good THEN round(principal, 4) END AS principal_exit_value_usdt, CASE WHEN good THEN round(fee, 4) END AS realized_fee_value_usdt, CASE WHEN good THEN round(lp, 4) END AS lp_exit_value_realized_fee_usdt, CASE WHEN good THEN round(hold, 4) END AS hodl_exit_value_usdt,
  CASE WHEN good THEN round(total, 9) END AS lp_total_return_realized_fee, CASE WHEN good THEN round((lp - hold) / hold, 9) END AS lp_excess_return_vs_hodl_realized_fee, CASE WHEN good THEN round(fee / initial, 9) END AS fee_return_on_initial_wealth, CASE WHEN good THEN round(daily, 9) END AS realized_daily_log_return, CASE WHEN good AND days > 0 THEN round(total / days, 9) END AS realized_daily_return_simple, round(days, 9) AS holding_days,
  CASE WHEN good THEN daily > 0 END AS daily_growth_above_0 FROM r""",
    "closed_position_returns": _FEES + _MARKET + ", whole AS (SELECT token_id, min(entry_sec) AS entry_sec, max(exit_sec) AS exit_sec, sum(entry_amount0_raw) AS entry_amount0_raw, sum(entry_amount1_raw) AS entry_amount1_raw, sum(exit_amount0_raw) AS exit_amount0_raw, sum(exit_amount1_raw) AS exit_amount1_raw, sum(fee0) AS fee0, sum(fee1) AS fee1 FROM fees WHERE included AND told AND token_id IS NOT NULL GROUP BY 1)" + _asof_prices("whole") + _values(("fee0", "fee1")) + """
SELECT token_id, round(d0, 6) AS deposit_token0, round(d1, 6) AS deposit_token1, round(w0, 6) AS withdraw_principal_token0, round(w1, 6) AS withdraw_principal_token1, round(f0, 6) AS fee_token0, round(f1, 6) AS fee_token1, round(initial, 4) AS initial_wealth_usdt, round(principal, 4) AS principal_exit_value_usdt, round(fee, 4) AS fee_exit_value_usdt, round(lp, 4) AS lp_exit_value_usdt, round(hold, 4) AS hodl_exit_value_usdt,
  CASE WHEN initial > 0 AND hold > 0 THEN round((lp - initial) / initial, 9) END AS lp_total_return_close_marked, CASE WHEN initial > 0 AND hold > 0 THEN round((lp - hold) / hold, 9) END AS lp_excess_return_vs_hodl_close, CASE WHEN initial > 0 AND hold > 0 THEN round(fee / initial, 9) END AS fee_return_on_initial_wealth, CASE WHEN initial > 0 AND hold > 0 THEN round((principal - hold) / hold, 9) END AS il_return_vs_hodl_fee_exclusive FROM v""",
    "position_risk": _LIFE + " SELECT operation_id, swaps, round(initial, 4) AS initial_wealth_usdt, " + ", ".join(f"round(({c}) / liquidity, 6) * liquidity / initial AS {n}" if scale == "ratio" else f"round(({c}) / {scale}, {6 if scale == 'liquidity' else 7}) * {scale} AS {n}" if scale else f"round({c}, 7) AS {n}" for n, (c, scale) in _MEASURES.items()) + " FROM held",
    "position_day_panel": _DAYS + ", sized AS (SELECT *, CASE WHEN is_terminal THEN initial_capital_usdt ELSE liquidity END AS own FROM panel) SELECT operation_id, day, is_terminal, swaps, round(external_price_usdt, 6) AS external_price_usdt, round(initial_capital_usdt, 4) AS initial_capital_usdt, round(lp_value_usdt / own, 6) * own AS lp_value_usdt, round(hodl_value_usdt / initial_capital_usdt, 6) * initial_capital_usdt AS hodl_value_usdt, round(il_loss_usdt / own, 6) * own AS il_loss_usdt, " + ", ".join(f"round({c} / liquidity, 6) * liquidity AS {c}" for c in DAILY[1:]) + " FROM sized",
    "portfolio_panel": _DAYS + ", g AS (SELECT day, count(*) AS position_day_count, sum(initial_capital_usdt) AS c, sum(liquidity) AS q, " + ", ".join(f"sum({x}) AS {x}" for x in DAILY) + " FROM panel GROUP BY 1), h AS (SELECT g.*, round(q / c, 3) AS weight, m.outside FROM g ASOF LEFT JOIN market m ON (g.day + 1) * 86400 > m.sec) SELECT day, position_day_count, round(c, 2) AS initial_capital_usdt, " + ", ".join(f"round({x} / q, 6) AS {x.replace('_usdt', '_per_liquidity')}" for x in DAILY) + ", 100 * round(il_loss_usdt / q, 6) * weight AS capital_weighted_il_loss_pct, 100 * round(lvr_rebalancing_usdt / q, 6) * weight AS capital_weighted_lvr_loss_pct, " + ", ".join(f"100 * round({x} / q, 6) * weight AS capital_weighted_{x.replace('_usdt', '_pct')}" for x in DAILY[2:]) + ", round(outside, 6) AS ethusdt_close, round(percent, 6) AS sofr_percent FROM h LEFT JOIN curve ON n = day",
}
