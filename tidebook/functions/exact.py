"""Ratios of wide decimals to 60 digits, for results that must be exact to the last digit.

The column path keeps sums as decimals and divides as doubles; this one is for audits.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 60


@F.udf(T.StringType(), useArrow=True)
def ratio_text(numerator: str | None, denominator: str | None) -> str | None:
    """numerator / denominator as text, both given as text; null if either is missing or the denominator is 0."""
    from decimal import Context, Decimal

    if numerator is None or denominator is None or not Decimal(denominator):
        return None
    context = Context(prec=DIGITS)
    return format(context.normalize(context.divide(Decimal(numerator), Decimal(denominator))), "f")
