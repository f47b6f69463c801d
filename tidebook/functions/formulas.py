"""Column formulas of concentrated-liquidity positions. Prices are token1 per token0, internal units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base of a tick, fixed-point one of a square-root price, scales of prices and liquidity.
TICK_BASE, Q96, PRICE_SCALE, LIQUIDITY_SCALE = 1.0001, 2.0**96, 1e12, 1e-12
DAY, RATE_YEAR = 86_400, 360


def positive(value: Column, what: str) -> Column:
    """The value, or an error if it is not finite and above 0; null stays null."""
    good = (value > 0) & (value < float("inf")) & ~F.isnan(value)
    return F.when(value.isNull() | good, value).otherwise(F.raise_error(F.lit(f"{what} must be finite and above 0")).cast("double"))


def tick_price(tick: Column, scale: float = PRICE_SCALE) -> Column:
    return F.pow(F.lit(TICK_BASE), tick.cast("double")) * F.lit(scale)


def sqrt_price(sqrt_x96: Column, scale: float = PRICE_SCALE) -> Column:
    """Price of a fixed-point square root given as text or number."""
    root = sqrt_x96.cast("double") / F.lit(Q96)
    return positive(root * root * F.lit(scale), "price")


def human_liquidity(raw: Column, scale: float = LIQUIDITY_SCALE) -> Column:
    return positive(raw.cast("double") * F.lit(scale), "liquidity")


def inventory(price: Column, low: Column, high: Column, liquidity: Column) -> tuple[Column, Column]:
    """Amounts of token0 and token1 that a position holds; outside its range the price counts as the nearer bound."""
    inside = F.greatest(low, F.least(price, high))
    return liquidity * (1 / F.sqrt(inside) - 1 / F.sqrt(high)), liquidity * (F.sqrt(inside) - F.sqrt(low))


def position_value(price: Column, low: Column, high: Column, liquidity: Column) -> Column:
    x, y = inventory(price, low, high, liquidity)
    return x * price + y


def rebalancing_step(before: Column, after: Column, outside: Column, low: Column, high: Column, liquidity: Column) -> Column:
    """What following one price move costs against trading the same amounts at the outside price; may be negative."""
    x0, y0 = inventory(before, low, high, liquidity)
    x1, y1 = inventory(after, low, high, liquidity)
    return -(outside * (x1 - x0) + (y1 - y0))


def convexity_cost(before: Column, after: Column, low: Column, high: Column, liquidity: Column) -> Column:
    """Value of the old inventory at the new price, less the position's value there.

    Inside the range the closed form is used, on one side of it the cost is 0, and across a bound
    the difference, where rounding below 0 counts as 0. Null if any input is null.
    """
    inside = before.between(low, high) & after.between(low, high)
    one_side = ((before <= low) & (after <= low)) | ((before >= high) & (after >= high))
    v0, v1 = position_value(before, low, high, liquidity), position_value(after, low, high, liquidity)
    x0, _ = inventory(before, low, high, liquidity)
    cost = v0 + x0 * (after - before) - v1
    noise = 1e-11 * F.greatest(F.abs(v0), F.abs(v1), F.lit(1.0))
    across = F.when(cost.isNull() | (cost >= 0), cost).when(cost >= -noise, F.lit(0.0)).otherwise(F.raise_error(F.lit("negative convexity cost")).cast("double"))
    return F.when(inside, liquidity * F.pow(F.sqrt(after) - F.sqrt(before), 2) / F.sqrt(before)).when(one_side, F.lit(0.0)).otherwise(across)


def daily_log_rate(percent: Column) -> Column:
    """Log growth of one day at a yearly rate in percent."""
    return F.log1p(percent / 100 / RATE_YEAR)
