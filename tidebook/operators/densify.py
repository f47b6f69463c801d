"""Dense calendars and grids, forward fills, gap runs and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.operators.ordered import stretch_of


def dense_days(df: DataFrame, day: str, values: list[str], by: list[str] | None = None, lead_in: bool = False, start: Column | None = None) -> DataFrame:
    """One row for each calendar day from the first (or ``start``) to the last, values carried forward.

    Days before ``start`` are dropped before the fill, as a plain reindex does; with ``lead_in``
    their last value is carried into the start. Several rows of one day: the greatest values hold.
    """
    by = by or []
    per_day = df.filter(F.col(day).isNotNull()).groupBy(*by, F.col(day).cast("date").alias(day)).agg(*[F.max(v).alias(v) for v in values])
    spans = per_day.groupBy(*by).agg(F.min(day).alias("__a"), F.max(day).alias("__z"))
    if start is not None:
        spans = spans.withColumn("__from", start)
    else:
        spans = spans.withColumn("__from", F.col("__a"))
    first = F.least("__a", "__from") if lead_in else F.col("__from")
    calendar = spans.filter(first <= F.col("__z")).select(*by, "__from", F.explode(F.sequence(first, "__z")).alias(day))
    w = Window.partitionBy(*by).orderBy(day) if by else Window.orderBy(day)
    filled = calendar.join(per_day, [*by, day], "left").select(*by, day, "__from", *[F.last(v, True).over(w).alias(v) for v in values])
    return filled.filter(F.col(day) >= F.col("__from")).drop("__from")


def dense_grid(ticks: DataFrame, at: str, price: str, volume: str, step: int, width: int, tie: str | None = None) -> DataFrame:
    """A regular grid of whole ``step`` units: the last price of each step carried forward, volumes summed, 0 where none.

    Of ticks at one time the one with the greatest ``tie`` is the last, or the greatest price without it.

    Result: at, price, volume, ``is_imputed``. The price that a stretch of ``width`` units inherits
    comes from a table of each stretch's last price, so no task orders the whole series.
    """
    cells = ticks.filter(F.col(at).isNotNull()).groupBy((F.floor(F.col(at) / step) * step).alias(at)).agg(F.max_by(F.col(price), F.struct(F.col(at), F.col(tie or price))).alias(price), F.sum(volume).alias(volume))
    cells = cells.withColumn("__w", stretch_of(at, width))
    span = cells.agg(F.min(at).alias("a"), F.max(at).alias("z")).filter("a is not null")
    windows = span.select("a", "z", F.explode(F.sequence(stretch_of("a", width), stretch_of("z", width))).alias("__w"))
    grid = windows.select("__w", F.explode(F.sequence(F.greatest(F.col("a"), F.ceil(F.col("__w") * width / step) * step), F.least(F.col("z"), F.ceil((F.col("__w") + 1) * width / step) * step - step), F.lit(step).cast("bigint"))).alias(at))
    lasts = windows.select("__w").join(cells.groupBy("__w").agg(F.max_by(price, at).alias("__p")), "__w", "left")
    carry = lasts.select("__w", F.last("__p", True).over(Window.partitionBy(F.lit(0)).orderBy("__w").rowsBetween(Window.unboundedPreceding, -1)).alias("__p"))
    local = Window.partitionBy("__w").orderBy(at)
    filled = grid.join(cells, ["__w", at], "left").withColumn("__local", F.last(price, True).over(local)).join(carry, "__w", "left")
    return filled.select(at, F.coalesce("__local", "__p").alias(price), F.coalesce(volume, F.lit(0)).alias(volume), F.col(price).isNull().alias("is_imputed"))


def grid_moves(ticks: DataFrame, at: str, price: str, step: int, tie: str) -> DataFrame:
    """The points of the dense grid of ``step`` units at which a new price arrives: at, price.

    All other points repeat the point before them. A tick counts from the first point at or after
    it; points after the last tick are not in the grid.
    """
    point = F.ceil(F.col(at) / step) * step
    last = ticks.agg(F.max(at).alias("__last"))
    cells = ticks.filter(F.col(at).isNotNull()).groupBy(point.cast("bigint").alias("__at")).agg(F.max_by(F.col(price), F.struct(F.col(at), F.col(tie))).alias(price))
    return cells.join(F.broadcast(last), F.col("__at") <= F.col("__last")).select(F.col("__at").alias(at), price)  # one row


def gap_runs(missing: DataFrame, at: str, step: int, by: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Maximal runs of consecutive missing grid points: ``gap_start``, ``gap_end`` (last missing point), ``points``.

    Runs are found within stretches of ``width`` units (by default 4,096 steps). One that touches
    a stretch's border joins its neighbour's by a table of at most two runs a stretch, so no task
    orders the whole series.
    """
    by, width = by or [], width or 4_096 * step
    rows = missing.filter(F.col(at).isNotNull()).select(*by, at, stretch_of(at, width).alias("__w"))
    island = F.col(at) - F.row_number().over(Window.partitionBy(*by, "__w").orderBy(at)) * step
    runs = rows.withColumn("__g", island).groupBy(*by, "__w", "__g").agg(F.min(at).alias("gap_start"), F.max(at).alias("gap_end"), F.count("*").alias("points"))
    # the point before or after a run at a border lies in another stretch
    touches = (stretch_of(F.col("gap_start") - step, width) < F.col("__w")) | (stretch_of(F.col("gap_end") + step, width) > F.col("__w"))
    series = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = series.orderBy("gap_start")
    border = runs.filter(touches).withColumn("__new", F.coalesce((F.col("gap_start") > F.lag("gap_end").over(w) + step).cast("int"), F.lit(1)))
    border = border.withColumn("__run", F.sum("__new").over(w)).groupBy(*by, "__run").agg(F.min("gap_start").alias("gap_start"), F.max("gap_end").alias("gap_end"), F.sum("points").alias("points"))
    columns = [*by, "gap_start", "gap_end", "points"]
    return runs.filter(~touches).select(*columns).unionByName(border.select(*columns))


def last_by_bin(ticks: DataFrame, at: str, price: str, step: int) -> DataFrame:
    """The last price of each bin of ``step`` units that has one."""
    return ticks.groupBy((F.floor(F.col(at) / step) * step).alias("bin_start")).agg(F.max_by(F.col(price), F.struct(F.col(at), F.col(price))).alias(price))


def week_ending_sunday(day: str | Column) -> Column:
    """The Sunday that ends the week of a day."""
    return F.date_add(F.date_trunc("week", day).cast("date"), 6)


def coverage_faults(parts: DataFrame, order: str, first: str, last: str, step: int) -> DataFrame:
    """Neighbouring partitions that overlap or leave a hole: order, ``fault`` and its ``size`` in units."""
    w = Window.orderBy(order)
    rows = parts.select(order, first, last, F.lag(last).over(w).alias("__last"))
    jump = F.col(first) - F.col("__last")
    fault = F.when(F.col(last) < F.col(first), "reversed").when(jump <= 0, "overlap").when(jump > step, "hole")
    return rows.select(order, fault.alias("fault"), jump.alias("size")).filter(F.col("fault").isNotNull())
