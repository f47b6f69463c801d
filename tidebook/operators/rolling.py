"""Rolling totals over trailing calendar periods, from event-contribution deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Amounts are added up exactly as decimals of this type, so that what leaves a window cancels what entered it.
EXACT = "decimal(38,9)"
LARGEST = 1e18


def rolling_totals(daily: DataFrame, keys: list[str], day: str, amounts: list[str], windows: list[int]) -> DataFrame:
    """Totals and averages of each amount over the last w days of every calendar day of each entity.

    daily: rows with ``keys``, a date ``day`` and numeric ``amounts``; several rows of one day add up.
    Result: keys, ``as_of`` (date), ``days_since_first``, and for each amount a and window w
    ``{a}_total_{w}d`` and ``{a}_mean_{w}d`` (total / w, so a day without a row counts as 0) as
    doubles, ``{a}_known_{w}d`` (days in the window with a usable value) and
    ``{a}_known_mean_{w}d`` (total / known days, null if there is none).

    Days run from the entity's first to its last date. Windows end with and include their day;
    near the start they cover the days there are, but are still divided by w. A null, NaN,
    infinite or larger than 1e18 amount is unusable: it adds 0 and no known day; amounts are kept
    to 9 decimals. Rows with a null day are left out; an entity without any day has no result.

    Each day's amount adds at its date and subtracts w days later; a running sum of these deltas
    is the total. Rows of a day combine before the shuffle, so an entity costs one row for each of
    its days whatever its number of rows.
    """
    usable = {a: F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(F.col(a).cast("double")) < LARGEST) for a in amounts}
    sums = [F.coalesce(F.sum(F.when(usable[a], F.col(a).cast(EXACT))), F.lit(0)).cast(EXACT).alias(f"x{i}") for i, a in enumerate(amounts)]
    known = [F.max(F.when(usable[a], 1).otherwise(0)).alias(f"k{i}") for i, a in enumerate(amounts)]
    per_day = daily.filter(F.col(day).isNotNull()).select(*[F.col(k).alias(f"e{i}") for i, k in enumerate(keys)], F.col(day).cast("date").alias("d"), *amounts)
    entity = [f"e{i}" for i in range(len(keys))]
    per_day = per_day.groupBy(*entity, "d").agg(*sums, *known)
    ends = Window.partitionBy(*entity)
    per_day = per_day.select("*", F.min("d").over(ends).alias("first"), F.max("d").over(ends).alias("last"))

    # one delta row at the date, one w days later for each w, and empty ones for all days up to the next of the entity
    after = F.lead("d").over(Window.partitionBy(*entity).orderBy("d"))
    filler = per_day.select("*", F.coalesce(F.date_sub(after, 1), F.col("last")).alias("until"))
    leaves = lambda w: [(-F.col(f"{c}{i}")).cast(EXACT if c == "x" else "int").alias(f"{c}{i}_{v}") if v == w else F.lit(0).cast(EXACT if c == "x" else "int").alias(f"{c}{i}_{v}") for i in range(len(amounts)) for c in "xk" for v in windows]
    empty = [F.lit(0).cast(EXACT if c == "x" else "int").alias(f"{c}{i}_{v}") for i in range(len(amounts)) for c in "xk" for v in windows]
    enters = [F.col(f"{c}{i}").cast(EXACT if c == "x" else "int").alias(f"{c}{i}_{v}") for i in range(len(amounts)) for c in "xk" for v in windows]
    arrays = [F.array(F.struct(F.col("d").alias("d"), *enters))]
    arrays += [F.array(F.struct(F.date_add("d", w).alias("d"), *leaves(w))) for w in windows]
    arrays += [F.transform(F.when(F.col("until") > F.col("d"), F.sequence(F.date_add("d", 1), "until")).otherwise(F.array().cast("array<date>")), lambda x: F.struct(x.alias("d"), *empty))]
    deltas = filler.select(*entity, "first", "last", F.explode(F.concat(*arrays)).alias("r")).select(*entity, "first", "last", "r.*").filter(F.col("d") <= F.col("last"))
    names = [f"{c}{i}_{v}" for i in range(len(amounts)) for c in "xk" for v in windows]
    folded = deltas.groupBy(*entity, "first", "d").agg(*[F.sum(n).alias(n) for n in names])
    run = Window.partitionBy(*entity).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    totals = folded.select(*entity, "d", F.datediff("d", "first").alias("since"), *[F.sum(n).over(run).alias(n) for n in names])
    out = [F.col(f"e{i}").alias(k) for i, k in enumerate(keys)] + [F.col("d").alias("as_of"), F.col("since").alias("days_since_first")]
    for i, a in enumerate(amounts):
        for w in windows:
            total, count = F.col(f"x{i}_{w}").cast("double"), F.col(f"k{i}_{w}").cast("bigint")
            out += [total.alias(f"{a}_total_{w}d"), (total / w).alias(f"{a}_mean_{w}d"), count.alias(f"{a}_known_{w}d"), F.when(count > 0, total / count).alias(f"{a}_known_mean_{w}d")]
    return totals.select(*out)
