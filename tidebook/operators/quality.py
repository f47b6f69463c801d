"""Data-quality rules as counting queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityError(ValueError):
    """A rule that must hold is violated."""


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row a rule: its name and the number of rows that break it; a null condition counts as broken. One pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"r{i}") for i, ok in enumerate(rules.values())])
    cells = [F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)]
    return counts.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def repeated_keys(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """rule and the number of keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def unmatched(df: DataFrame, other: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """rule and the number of rows whose keys the other table lacks."""
    return df.join(other, keys, "left_anti").agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require(violations: DataFrame) -> None:
    """Raise if any rule is broken. The table has one row a rule."""
    broken = violations.filter("violations > 0").collect()
    if broken:
        raise QualityError("; ".join(f"{r['rule']}: {r['violations']}" for r in broken))


def require_columns(df: DataFrame, columns: dict[str, str]) -> None:
    """Raise unless the columns are there with these types."""
    have = dict(df.dtypes)
    wrong = [f"{c}: {have.get(c, 'missing')}, not {kind}" for c, kind in columns.items() if have.get(c) != kind]
    if wrong:
        raise QualityError("; ".join(wrong))
