"""Descriptive statistics, rank correlation, regression and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.util import entity_key, materialise, partitions_for


def finite(column: str) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = F.col(column)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def describe(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """One row a column: count, mean, std (sample), min, percentiles (exact, linear) and max of its finite values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), finite(c).alias("v")) for c in columns])).alias("x")).select("x.*")
    cells = [F.percentile("v", p).alias(f"p{round(100 * p):02d}") for p in probabilities]
    return long.groupBy("column_name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), *cells, F.max("v").alias("max"))


def value_ranks(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """by, column, n and ``rank`` of each distinct value: its place among all rows, ties having the mean of theirs.

    Equal values are counted first. The distinct values are placed by ranges into a table of
    numbered parts, so no task orders the whole column; what lies below a part is a sum over parts.
    Nulls in ``by`` are values; a null value is the lowest.
    """
    by = by or []
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n")).withColumn("__e", entity_key(by) if by else F.lit(""))
    parts = partitions_for(df, 64 << 20)
    placed = materialise(counts.repartitionByRange(parts, "__e", column).withColumn("__w", F.spark_partition_id()), "ranks")
    earlier = Window.partitionBy("__e").orderBy("__w").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__e", "__w").agg(F.sum("n").alias("__n")).select("__e", "__w", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__e", "__w").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("__start") + F.coalesce(F.sum("n").over(within), F.lit(0)) + (F.col("n") + 1) / 2
    return placed.join(starts, ["__e", "__w"]).select(*by, column, "n", rank.alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns over rows where both are present."""
    rows = materialise(df.select(finite(x).alias("x"), finite(y).alias("y")).dropna(), "rank-pairs")
    ranked = rows
    for c in ("x", "y"):
        ranked = ranked.join(value_ranks(rows, c).select(c, F.col("rank").alias(f"r{c}")), c)
    return ranked.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def simple_regression(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, intercept, slope, r_squared and rmse of y on x; groups of fewer than 3 rows have nulls.

    All from one pass of sums; the residual sum follows from them.
    """
    rows = df.select(*by, F.col(x).alias("__x"), F.col(y).alias("__y")).filter(F.col("__x").isNotNull() & F.col("__y").isNotNull())
    fit = rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_intercept("__y", "__x").alias("intercept"), F.regr_slope("__y", "__x").alias("slope"), F.regr_r2("__y", "__x").alias("r_squared"), F.regr_syy("__y", "__x").alias("__syy"))
    enough = F.col("n") >= 3
    rmse = F.sqrt(F.greatest(F.col("__syy") * (1 - F.col("r_squared")), F.lit(0.0)) / F.col("n"))
    return fit.select(*by, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("intercept", "slope", "r_squared")], F.when(enough, rmse).alias("rmse"))


def shares(df: DataFrame, group: list[str], item: str) -> DataFrame:
    """Counts of an item within a group and their share of the group in percent."""
    counts = df.groupBy(*group, item).agg(F.count("*").alias("n"))
    return counts.withColumn("share_pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def inconsistent(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose rows disagree in a column, a null counting as a value of its own."""
    kinds = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"{c}_values") for c in columns]
    bad = F.lit(False)
    for c in columns:
        bad |= F.col(f"{c}_values") > 1
    return df.groupBy(*keys).agg(*kinds).filter(bad)
