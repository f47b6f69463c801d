"""Returns of closed positions in two tokens.

Amounts come as raw integers, prices as doubles; values and ratios are doubles. What must be exact
to the last digit is ``functions.exact``'s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS_A_DAY = 86_400


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0.0))


def valued(df: DataFrame, deposit: tuple[str, str], principal: tuple[str, str], fee: tuple[str, str], prices: dict[str, tuple[Column, Column]], decimals: tuple[int, int]) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with human amounts, and the columns of values at entry and exit prices.

    prices: 'entry' and 'exit' -> prices of the two tokens.
    """
    names = {}
    for label, (a, b) in (("deposit", deposit), ("withdraw_principal", principal), ("fee", fee)):
        for i, c in enumerate((a, b)):
            df = df.withColumn(f"{label}_token{i}", F.col(c).cast("double") / F.lit(10.0 ** decimals[i]))
            names[label, i] = F.col(f"{label}_token{i}")
    value = lambda label, at: names[label, 0] * prices[at][0] + names[label, 1] * prices[at][1]
    return df, {"initial": value("deposit", "entry"), "principal": value("withdraw_principal", "exit"), "fee": value("fee", "exit"), "hold": value("deposit", "exit")}


def closed_returns(df: DataFrame, deposit: tuple[str, str], principal: tuple[str, str], fee: tuple[str, str], prices: dict[str, tuple[Column, Column]], decimals: tuple[int, int] = (18, 6)) -> DataFrame:
    """Amounts, values and returns of closed positions: 15 columns added to the rows.

    A position whose initial or held value is not above 0, or that lacks an amount or a price, has
    null returns.
    """
    rows, v = valued(df, deposit, principal, fee, prices, decimals)
    rows = rows.select("*", v["initial"].alias("initial_wealth_usdt"), v["principal"].alias("principal_exit_value_usdt"), v["fee"].alias("fee_exit_value_usdt"), (v["principal"] + v["fee"]).alias("lp_exit_value_usdt"), v["hold"].alias("hodl_exit_value_usdt"))
    good = (F.col("initial_wealth_usdt") > 0) & (F.col("hodl_exit_value_usdt") > 0)
    initial, hold, out = F.col("initial_wealth_usdt"), F.col("hodl_exit_value_usdt"), F.col("lp_exit_value_usdt")
    kept = {"lp_total_return_close_marked": _ratio(out - initial, initial), "lp_excess_return_vs_hodl_close": _ratio(out - hold, hold), "fee_return_on_initial_wealth": _ratio(F.col("fee_exit_value_usdt"), initial), "il_return_vs_hodl_fee_exclusive": _ratio(F.col("principal_exit_value_usdt") - hold, hold)}
    return rows.select("*", *[F.when(good, c).alias(n) for n, c in kept.items()])


def pair_returns(df: DataFrame, deposit: tuple[str, str], principal: tuple[str, str], fee: tuple[str, str], prices: dict[str, tuple[Column, Column]], holding_seconds: str, included: Column, decimals: tuple[int, int] = (18, 6)) -> DataFrame:
    """Values and returns of pairs: 12 columns added to the rows.

    Excluded rows, and those without a positive initial and held value, have nulls but for
    ``holding_days``. Daily returns need a holding time above 0, logarithms a return above -1.
    """
    rows, v = valued(df, deposit, principal, fee, prices, decimals)
    rows = rows.withColumns({"__initial": v["initial"], "__hold": v["hold"], "__principal": v["principal"], "__fee": v["fee"]})
    good = F.coalesce(included, F.lit(False)) & (F.col("__initial") > 0) & (F.col("__hold") > 0)
    initial, hold, out = F.col("__initial"), F.col("__hold"), F.col("__principal") + F.col("__fee")
    total, days = _ratio(out - initial, initial), F.col(holding_seconds).cast("double") / SECONDS_A_DAY
    daily = F.when((total > -1) & (days > 0), F.log1p(total) / F.nullif(days, F.lit(0.0)))
    cells = {"initial_wealth_usdt": initial, "principal_exit_value_usdt": F.col("__principal"), "realized_fee_value_usdt": F.col("__fee"), "lp_exit_value_realized_fee_usdt": out, "hodl_exit_value_usdt": hold, "lp_total_return_realized_fee": total, "lp_excess_return_vs_hodl_realized_fee": _ratio(out - hold, hold), "fee_return_on_initial_wealth": _ratio(F.col("__fee"), initial), "realized_daily_log_return": daily, "realized_daily_return_geometric": F.expm1(daily), "realized_daily_return_simple": F.when(days > 0, total / F.nullif(days, F.lit(0.0)))}
    return rows.select(*df.columns, *[F.when(good, c).alias(n) for n, c in cells.items()], days.alias("holding_days"))
