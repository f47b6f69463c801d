"""Exact arithmetic on integer text of up to 84 digits, in JVM columns only.

A number is held as three signed limbs of 28 digits, lowest first. Sums of limbs stay exact as
``decimal(38,0)`` for up to 10**10 rows; carries are settled only when a sign is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS = 3
DIGITS = 28
LIMB = f"decimal({DIGITS},0)"
SUM = "decimal(38,0)"


def digits(text: Column) -> Column:
    """The digits of integer text, whatever its blanks, sign and leading zeros; null if it is none or longer than 84."""
    bare = F.regexp_replace(text, r"\s+", "")
    found = F.regexp_extract(bare, r"^[+-]?0*([0-9]{1,84})$", 1)
    return F.when(found != "", found)


def is_negative(text: Column) -> Column:
    """Whether integer text has a minus sign."""
    return F.regexp_replace(text, r"\s+", "").startswith("-")


def limbs(number: Column, sign: Column) -> list[Column]:
    """Signed limbs of a digit string; a null number counts as zero."""
    padded = F.lpad(F.coalesce(number, F.lit("0")), LIMBS * DIGITS, "0")
    parts = [F.substring(padded, (LIMBS - 1 - i) * DIGITS + 1, DIGITS).cast(LIMB) for i in range(LIMBS)]
    return [F.when(sign < 0, -p).otherwise(p).cast(LIMB) for p in parts]


def sign_of(parts: list[Column]) -> Column:
    """-1, 0 or 1: the sign of the number that unsettled sums of limbs stand for."""
    base = F.expr(f"cast('1{'0' * DIGITS}' as decimal({DIGITS + 1},0))")
    rest, carry = F.lit(False), F.lit(0).cast(SUM)
    for part in parts[:-1]:
        whole = (part.cast(SUM) + carry).cast(SUM)
        low = F.pmod(whole, base)
        carry = ((whole - low) / base).cast("decimal(12,0)")
        rest = rest | (low != 0)
    top = (parts[-1].cast(SUM) + carry).cast(SUM)
    return F.when(top < 0, F.lit(-1)).when((top > 0) | rest, F.lit(1)).otherwise(F.lit(0))
