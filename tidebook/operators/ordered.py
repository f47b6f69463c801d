"""Ordered algebra: order keys, running values and as-of lookups that never sort one series in one task.

A long series is cut into stretches of its order column. Each stretch is windowed by itself; what
it inherits from earlier ones comes from a table with one row a stretch, which is windowed and
joined back. Only that small table is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.util import materialise

#: Bounds of the packed order key: block * 10**10 + transaction * 10**5 + log. What exceeds them takes ``block_position_key``.
PER_BLOCK, PER_TRANSACTION = 10**10, 10**5


def order_key(block: str, transaction: str, log: str) -> Column:
    """One bigint that orders events; raises for parts that would not fit."""
    b, t, g = F.col(block).cast("bigint"), F.col(transaction).cast("bigint"), F.col(log).cast("bigint")
    fits = (b >= 0) & (b < 9 * 10**8) & (t >= 0) & (t < PER_TRANSACTION) & (g >= 0) & (g < PER_TRANSACTION)
    return F.when(fits, b * PER_BLOCK + t * PER_TRANSACTION + g).when(b.isNull() | t.isNull() | g.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("event order out of range")).cast("bigint"))


def block_position_key(block: str, transaction: str, log: str) -> Column:
    """The same order as a block's start and a place within it; only a block's rows are bounded, by ``PER_BLOCK``.

    A window over each block, so it must see all events of the block. Events that agree in all
    three parts have one key.
    """
    b, place = F.col(block).cast("bigint"), F.rank().over(Window.partitionBy(block).orderBy(transaction, log))
    fits = (b >= 0) & (b < 9 * 10**8) & (place < PER_BLOCK)
    return F.when(b.isNull() | F.col(transaction).isNull() | F.col(log).isNull(), F.lit(None)).when(fits, b * PER_BLOCK + place).otherwise(F.raise_error(F.lit("event order out of range")).cast("bigint"))


def stretch_of(column: str | Column, width: int) -> Column:
    """Number of the stretch of ``width`` units that a whole number lies in."""
    c = F.col(column) if isinstance(column, str) else column
    w = F.lit(width).cast("bigint")
    return F.call_function("div", c.cast("bigint") - F.pmod(c.cast("bigint"), w), w)


def running_sums(df: DataFrame, order: str, ties: list[str], sums: dict[str, Column], width: int, by: list[str] | None = None) -> DataFrame:
    """Add running sums in the order of (order, ties), the row itself included.

    ``by`` splits the rows into series of their own (none of the columns may be null). The order
    column is a whole number; ``width`` should give each stretch at most some million rows.
    """
    by = by or []
    temp = {name: f"__v{i}" for i, name in enumerate(sums)}
    rows = df.select("*", stretch_of(order, width).alias("__w"), *[value.alias(temp[name]) for name, value in sums.items()])
    totals = rows.groupBy(*by, "__w").agg(*[F.sum(v).alias(v) for v in temp.values()])
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__w").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "__w", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}s") for v in temp.values()])
    within = Window.partitionBy(*by, "__w").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(starts, [*by, "__w"]).select("*", *[(F.col(f"{v}s") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(name) for name, v in temp.items()])
    return out.drop("__w", *temp.values(), *[f"{v}s" for v in temp.values()])


def asof_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, values: list[str], width: int, by: list[str] | None = None, strict: bool = True, tolerance: int | None = None, tie: str | None = None) -> DataFrame:
    """Left rows with the values of the last right row before them (or at them, if not strict).

    Times are whole numbers; the right side's span should be at most some million stretches of
    ``width``. ``tie`` orders right rows of the same time; without it the greatest
    values win. A match older than ``tolerance`` counts as none. Rows without a match, with a null
    time or a null ``by`` column keep null values. Adds the values and ``{right_at}_matched``.
    """
    by = by or []
    found = F.struct(F.col(right_at).alias("at"), *([F.col(tie).alias("tie")] if tie else []), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    names = left.columns
    prices = right.filter(F.col(right_at).isNotNull()).select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], F.col(right_at).cast("bigint").alias("__t"), F.lit(1 if strict else 0).alias("__side"), found.alias("__r"))
    probes = left.select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], F.col(left_at).cast("bigint").alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.struct(*names).alias("__l"))
    keys = [f"__b{i}" for i in range(len(by))]
    prices = prices.withColumn("__w", stretch_of("__t", width))
    probes = probes.withColumn("__w", stretch_of("__t", width))
    # what a stretch inherits comes from the right side alone, so the left side is computed once
    lasts = prices.groupBy(*keys, "__w").agg(F.max("__r").alias("__c"))
    series = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    lasts = lasts.withColumn("__next", F.lead("__w").over(series.orderBy("__w")))
    carried = lasts.filter(F.col("__next").isNotNull()).select(*keys, F.explode(F.sequence(F.col("__w") + 1, "__next")).alias("__w"), "__c")
    tails = lasts.filter(F.col("__next").isNull()).select(*keys, F.col("__w").alias("__tw"), F.col("__c").alias("__tc"))
    within = Window.partitionBy(*keys, "__w").orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    rows = probes.unionByName(prices, allowMissingColumns=True)
    local = rows.select(*keys, "__w", "__t", "__l", F.last("__r", True).over(within).alias("__m")).filter(F.col("__l").isNotNull())
    out = local.join(carried, [*keys, "__w"], "left")
    # without keys the tail is one row
    out = out.join(tails, keys, "left") if keys else out.join(F.broadcast(tails), F.lit(True), "left")
    out = out.withColumn("__c", F.coalesce("__c", F.when(F.col("__w") > F.col("__tw"), F.col("__tc"))))
    match = F.coalesce("__m", "__c")
    usable = F.col("__t").isNotNull()
    for k in keys:
        usable &= F.col(k).isNotNull()
    if tolerance is not None:
        usable &= F.col("__t") - match["at"] <= tolerance
    return out.select(*[F.col("__l")[n].alias(n) for n in names], *[F.when(usable, match[f"v{i}"]).alias(v) for i, v in enumerate(values)], F.when(usable, match["at"]).alias(f"{right_at}_matched"))


def exact_prior(left: DataFrame, grid: DataFrame, left_at: str, grid_at: str, values: list[str], back: int = 1, required: bool = True) -> DataFrame:
    """Left rows with the values of the grid point exactly ``back`` units before them; an equality join.

    A time that is not whole is an error, and so, if ``required``, is a point that the grid lacks;
    otherwise its values are null. A null time has none. The grid holds each point once.
    """
    at = F.col(left_at)
    whole = F.when(at.isNull() | (at == F.floor(at)), at.cast("bigint")).otherwise(F.raise_error(F.lit("time is not whole")).cast("bigint"))
    points = grid.select((F.col(grid_at) + back).alias("__g"), F.struct(*values).alias("__v"))
    found = left.withColumn("__t", whole).join(points, F.col("__t") == F.col("__g"), "left")
    there = F.col("__v").isNotNull() | F.col("__t").isNull() | F.lit(not required)
    held = F.when(there, F.col("__v")).otherwise(F.raise_error(F.lit("no grid point before this time")).cast(points.schema["__v"].dataType))
    return found.withColumn("__h", held).select(*[F.col(c) for c in left.columns], *[F.col(f"__h.{v}").alias(v) for v in values])


def interval_join(intervals: DataFrame, points: DataFrame, start: str, end: str, at: str, width: int, strict_start: bool = True, strict_end: bool = True) -> DataFrame:
    """Every (interval, point) with the point inside, by equi-join on stretches of ``width`` units.

    An interval goes to each stretch it touches, so long ones are spread; the exact bounds are
    checked after the join. Points and bounds are whole numbers; null ones match nothing.
    """
    spread = intervals.filter(F.col(start) < F.col(end)).withColumn("__w", F.explode(F.sequence(stretch_of(start, width), stretch_of(end, width))))
    placed = points.withColumn("__w", stretch_of(at, width))
    after = F.col(at) > F.col(start) if strict_start else F.col(at) >= F.col(start)
    before = F.col(at) < F.col(end) if strict_end else F.col(at) <= F.col(end)
    return spread.join(placed, "__w").filter(after & before).drop("__w")


def interval_extremes(intervals: DataFrame, key: list[str], points: DataFrame, start: str, end: str, at: str, value: str, low: str, high: str, width: int, fan: int = 256) -> DataFrame:
    """Of each interval with points strictly inside: their number, greatest and least value, and how many lie in [low, high].

    No interval meets its points: the points are numbered, ``fan`` of them make a block, ``fan``
    blocks one of the next level. An interval looks into two blocks of each level, so it costs two
    lookups a level whatever its length. What lies in a range before a block is a running sum, of a row
    for each block and distinct (low, high), so there should be few distinct ranges. Gives the key,
    ``trades``, ``highest``, ``lowest`` and ``in_range``. Null places match nothing.
    """
    place = points.filter(F.col(at).isNotNull()).select(F.col(at).alias("__k"), F.col(value).alias("__v"))
    numbered = materialise(running_sums(place, "__k", [], {"__n": F.lit(1)}, width), "numbered-points")
    held = intervals.filter(F.col(start) < F.col(end)).select(*key, start, end, F.col(low).alias("__low"), F.col(high).alias("__high"))
    for side, place, strict in (("a", start, False), ("b", end, True)):
        held = asof_join(held, numbered, place, "__k", ["__n"], width, strict=strict).withColumn(f"__{side}", F.coalesce("__n", F.lit(0).cast("bigint"))).drop("__n", "__k_matched", place)
    # numbers from 0, both ends inside
    held = materialise(held.filter(F.col("__b") > F.col("__a")).withColumn("__b", F.col("__b") - 1), "numbered-intervals")
    count = numbered.agg(F.coalesce(F.max("__n"), F.lit(0))).first()[0]

    block = lambda c: F.call_function("div", F.col(c), F.lit(fan).cast("bigint"))
    within = lambda c: F.pmod(F.col(c), F.lit(fan).cast("bigint"))
    grouped = lambda rows, *cells: rows.groupBy(block("__i").alias("__node")).agg(F.sort_array(F.collect_list(F.struct("__i", *cells))).alias("__c"))
    listed = numbered.withColumn("__i", F.col("__n") - 1)
    ranges = F.broadcast(held.select("__low", "__high").distinct())
    counts = listed.crossJoin(ranges).groupBy(block("__i").alias("__i"), "__low", "__high").agg(F.count_if(F.col("__v").between(F.col("__low"), F.col("__high"))).alias("__c"))
    before = running_sums(counts, "__i", [], {"__s": F.col("__c")}, 4_096, by=["__low", "__high"])
    before = before.groupBy(F.col("__i").alias("__node")).agg(F.collect_list(F.struct("__low", "__high", (F.col("__s") - F.col("__c")).alias("n"))).alias("__before"))
    leaves = grouped(listed, "__v").select("__node", F.col("__c.__v").alias("__max")).withColumn("__min", F.col("__max")).join(before, "__node", "left")
    nodes = materialise(leaves, "point-blocks")

    part = lambda values, first, last: F.slice(values, (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))
    below = F.filter(F.col("__before"), lambda x: (x["__low"] == F.col("__low")) & (x["__high"] == F.col("__high")))
    hits = lambda last: F.get(below, F.lit(0))["n"] + F.size(F.filter(part("__max", F.lit(0), last), lambda v: v.between(F.col("__low"), F.col("__high"))))
    out, found = held.withColumns({"__l": F.col("__a"), "__r": F.col("__b")}), {"highest": [], "lowest": []}
    level = 0
    while True:
        same = block("__l") == block("__r")
        # the ends lie inside on the first level; above it, what lies between the blocks of the level below
        step = 1 if level else 0
        first = {"l": within("__l") + step, "r": F.when(same, within("__l") + step).otherwise(0)}
        last = {"l": F.when(same, within("__r") - step).otherwise(fan - 1), "r": within("__r") - step}
        for side in ("l", "r"):
            joined = out.withColumn("__node", block(f"__{side}")).join(nodes, "__node")
            cells = {f"__{name}{side}{level}": best(part(f"__{values}", first[side], last[side])) for name, values, best in (("highest", "max", F.array_max), ("lowest", "min", F.array_min))}
            if not level:
                cells[f"__n{side}"] = hits(within("__l") - 1 if side == "l" else within("__r"))
            out = joined.withColumns(cells).drop("__node", "__max", "__min", "__before")
            for name in found:
                found[name].append(f"__{name}{side}{level}")
        level += 1
        if fan**level >= count:
            break
        summary = nodes.select(F.col("__node").alias("__i"), F.array_max("__max").alias("__max"), F.array_min("__min").alias("__min"))
        nodes = materialise(grouped(summary, "__max", "__min").select("__node", F.col("__c.__max").alias("__max"), F.col("__c.__min").alias("__min")), "point-blocks")
        out = out.withColumns({"__l": block("__l"), "__r": block("__r")})
    return out.select(*key, (F.col("__b") - F.col("__a") + 1).alias("trades"), F.greatest(*found["highest"]).alias("highest"), F.least(*found["lowest"]).alias("lowest"), (F.col("__nr") - F.col("__nl")).alias("in_range"))


def block_ends(df: DataFrame, by: list[str], block: str, order: list[str]) -> Column:
    """Whether a row is the last of its block within its series; sorted block by block, however long the series."""
    return F.row_number().over(Window.partitionBy(*by, block).orderBy(*[F.desc(c) for c in order])) == 1


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in a total order; the aggregate combines before the shuffle."""
    rest = [c for c in df.columns if c not in {*keys, *order}]
    best = F.max(F.struct(*order, *rest)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def top_per_cell(df: DataFrame, cell: list[str], order: list[Column]) -> DataFrame:
    """The first row of each cell; Spark keeps one row a cell and task before the shuffle (a window group limit)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).filter("__n = 1").drop("__n")
