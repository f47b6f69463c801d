"""Path-dependent measures of positions, without meeting every position with every price.

What the moves in a position's life cost it is a sum over prices below its two bounds, so it is
answered by sums over (moves before a time, prices below a bound). These come from a tree over the
numbered moves: a node covers a power of two of consecutive moves and holds their sums by price
bucket, where buckets are cut at the positions' bounds. A move is in about half the levels of the
tree, and a lookup reads about as many nodes. Positions and moves may be of any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.functions.formulas import DAY, daily_log_rate
from tidebook.operators.ordered import asof_join, running_sums, stretch_of
from tidebook.util import entity_key, materialise

#: Stretches of price within which bounds are listed: this many to a factor of e, so at most eleven ticks each.
PER_E = 1_024


def lag_in_path(path: DataFrame, order: str, columns: dict[str, str], width: int, by: list[str] | None = None) -> DataFrame:
    """Add the previous row's values in each long series; the first of a stretch looks to the stretch before.

    The columns ``by`` tell series apart and are not null.
    """
    by = by or []
    within = Window.partitionBy(*by, "__w").orderBy(order)
    rows = path.withColumn("__w", stretch_of(order, width))
    ends = rows.groupBy(*by, "__w").agg(*[F.max_by(c, order).alias(f"__e{i}") for i, c in enumerate(columns)])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__w")
    ends = ends.select(*by, "__w", *[F.lag(f"__e{i}").over(before).alias(f"__e{i}") for i in range(len(columns))])
    out = rows.join(ends, [*by, "__w"]).withColumns({name: F.coalesce(F.lag(c).over(within), F.col(f"__e{i}")) for i, (c, name) in enumerate(columns.items())})
    return out.drop("__w", *[f"__e{i}" for i in range(len(columns))])


def rate_curve(days: DataFrame, day: str, percent: str) -> DataFrame:
    """A dense daily curve with ``start``, the log growth from its first day up to each day's start, and the day's ``log_rate``."""
    rows = days.select(F.col(day).alias("day_number"), daily_log_rate(F.col(percent)).alias("log_rate"))
    before = Window.orderBy("day_number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("day_number", "log_rate", F.coalesce(F.sum("log_rate").over(before), F.lit(0.0)).alias("start"))


def with_growth(df: DataFrame, curve: DataFrame, sec: str, name: str) -> DataFrame:
    """Add the log growth of the curve up to a time in seconds."""
    rows = df.withColumn("day_number", F.floor(F.col(sec) / DAY)).join(curve, "day_number", "left")
    return rows.withColumn(name, F.col("start") + F.col("log_rate") * (F.pmod(F.col(sec), F.lit(DAY)) / DAY)).drop("day_number", "start", "log_rate")


def _price_stretch(price: Column) -> Column:
    """Number of the stretch of a price; grows with the price. All prices of 0 or less share one."""
    return F.when(price > 0, F.floor(F.log(price) * PER_E)).otherwise(F.lit(-(2**40)))


def _bound_ranks(bounds: DataFrame) -> DataFrame:
    """stretch, ``ks`` (sorted distinct bounds) and ``lower`` (how many bounds lie in lower stretches).

    The range of doubles has at most 1.5 million stretches, so this table may be ordered as a whole.
    """
    listed = bounds.groupBy(_price_stretch(F.col("k")).alias("ps")).agg(F.sort_array(F.collect_set("k")).alias("ks"))
    w = Window.partitionBy(F.lit(0)).orderBy("ps")
    earlier = F.sum(F.size("ks")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return listed.select("ps", "ks", F.coalesce(earlier, F.lit(0)).alias("lower"), F.lead("ps").over(w).alias("following"))


def range_sums(positions: DataFrame, key: list[str], moves: DataFrame, order: str, points: Column, measures: list[str], entry: str, exit_: str, width: int, strict: bool = True, by: str | None = None) -> DataFrame:
    """Positions with sums over the moves in (entry, exit), or (entry, exit] if not strict.

    points: for each move an array of structs of a price ``at`` and the ``measures``. Adds ``moves``
    (their number) and for each measure ``{measure}_low`` and ``{measure}_high``: its sum over the
    points whose price is below the position's ``low`` or ``high``. ``points``, ``points_low`` and
    ``points_high`` count the points in the life, and those below each bound. The key tells positions apart.
    ``by`` names a column of both tables (a text, not null) that splits them into paths of their own.

    A position without moves, with a null bound, or with an entry not before its exit has sums of
    0; null prices and measures count for nothing. Bounds should be prices of ticks: those of one
    stretch of 1/1024 of log price are listed in one row.
    """
    names = {f"{m}_{side}": f"m{n}_{side}" for n, m in enumerate([*measures, "points"]) for side in ("low", "high")}
    inner = [f"m{n}" for n in range(len(measures) + 1)]
    cells = lambda p: F.struct(p["at"].alias("at"), *[p[m].alias(f"m{n}") for n, m in enumerate(measures)], F.lit(1.0).alias(inner[-1]))
    points = F.coalesce(F.filter(F.transform(points, cells), lambda p: p["at"].isNotNull() & ~F.isnan(p["at"])), F.transform(F.filter(points, lambda _: F.lit(False)), cells))
    path = F.col(by) if by else F.lit("")
    numbered = running_sums(moves.filter(F.col(order).isNotNull()).select(path.alias("g"), F.col(order).cast("bigint").alias("k"), points.alias("points")), "k", [], {"i": F.lit(1), "c": F.coalesce(F.greatest(F.size("points"), F.lit(0)), F.lit(0))}, width, by=["g"])
    numbered = materialise(numbered.select("g", "k", "i", "c", "points"), "path-numbers")
    count = numbered.agg(F.coalesce(F.max("i"), F.lit(0))).first()[0]
    levels = int(count).bit_length()
    # the moves up to the entry are taken from those before (or up to) the exit
    last = F.col(exit_).cast("bigint") + F.lit(0 if strict else 1)
    ends = F.array(F.struct(F.lit(-1).alias("sign"), (F.col(entry).cast("bigint") + 1).alias("t")), F.struct(F.lit(1).alias("sign"), last.alias("t")))
    alive = positions.filter(F.col(entry) < F.col(exit_)).select(path.alias("g"), entity_key(key).alias("e"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), F.explode(ends).alias("x")).select("g", "e", "low", "high", "x.*")
    ends = asof_join(alive, numbered.select("g", "k", "i", "c"), "t", "k", ["i", "c"], width, by=["g"]).filter("i IS NOT NULL").select("g", "e", "low", "high", "sign", "i", "c")
    ends = materialise(ends, "path-ends")  # read for the bounds, the probes and the lookups

    ranks = materialise(_bound_ranks(ends.select(F.explode(F.array("low", "high")).alias("k")).dropna().distinct()), "path-bounds")
    lowest, bounds = ranks.agg(F.min("ps"), F.coalesce(F.sum(F.size("ks")), F.lit(0))).first()
    every = ranks.select(F.explode(F.sequence("ps", F.coalesce(F.col("following") - 1, F.col("ps")))).alias("ps"), F.col("ps").alias("own"), "ks", "lower")
    place = F.when(F.col("ps") == F.col("own"), F.size(F.filter("ks", lambda k: k <= F.col("at")))).otherwise(F.size("ks"))
    spot = numbered.select("g", "i", F.explode("points").alias("p")).select("g", "i", "p.*").withColumn("ps", _price_stretch(F.col("at")))
    beyond = F.when(F.col("ps") < F.lit(lowest), F.lit(0)).otherwise(F.lit(bounds))
    spot = spot.join(every, "ps", "left").select("g", "i", F.coalesce(F.col("lower") + place, beyond).cast("bigint").alias("bucket"), *inner)
    # node of level k: the next multiple of 2**k, if odd; it covers the 2**k moves up to it
    up = lambda k: F.shiftright("i", k) + F.when(F.col("i").bitwiseAND(F.lit((1 << k) - 1)) != 0, 1).otherwise(0)
    over = F.array_compact(F.array(*[F.when((up(k).bitwiseAND(F.lit(1)) == 1) & (F.shiftleft(up(k), k) <= count), F.shiftleft(up(k), k)) for k in range(levels)])) if levels else F.array().cast("array<bigint>")
    under = F.array_compact(F.array(*[F.when(F.shiftright("i", k).bitwiseAND(F.lit(1)) == 1, F.shiftleft(F.shiftright("i", k), k)) for k in range(levels)])) if levels else F.array().cast("array<bigint>")
    tree = spot.select("g", F.explode(over).alias("node"), "bucket", *inner).groupBy("g", "node", "bucket").agg(*[F.sum(m).alias(m) for m in inner])

    rank = ranks.select(F.posexplode("ks").alias("n", "k"), "lower").select("k", (F.col("lower") + F.col("n")).cast("bigint").alias("bucket"))
    sides = F.explode(F.array(F.struct(F.lit("low").alias("side"), F.col("low").alias("k")), F.struct(F.lit("high").alias("side"), F.col("high").alias("k")))).alias("s")
    probes = ends.select("g", "e", "sign", "i", sides).select("g", "e", "sign", "i", "s.*").join(rank, "k").select("g", "e", "sign", "side", "bucket", F.explode(under).alias("node"))
    asked = probes.select("g", "node", "bucket").distinct().withColumn("asked", F.lit(1))
    # a node has at most one row for each bucket, and a probe adds no row of its own
    rows = tree.unionByName(asked, allowMissingColumns=True).groupBy("g", "node", "bucket").agg(F.max("asked").alias("asked"), *[F.sum(m).alias(m) for m in inner])
    w = Window.partitionBy("g", "node").orderBy("bucket")
    below = rows.select("g", "node", "bucket", "asked", *[F.coalesce(F.sum(m).over(w), F.lit(0.0)).alias(m) for m in inner]).filter("asked = 1").drop("asked")
    sums = probes.join(below, ["g", "node", "bucket"]).groupBy("e").agg(*[F.sum(F.when(F.col("side") == side, F.col("sign") * F.col(m))).alias(f"{m}_{side}") for m in inner for side in ("low", "high")])
    counts = ends.groupBy("e").agg(F.sum(F.col("sign") * F.col("i")).alias("__moves"), F.sum(F.col("sign") * F.col("c")).alias("__points"))
    out = positions.withColumn("__e", entity_key(key)).join(counts, F.col("__e") == counts["e"], "left").drop("e").join(sums, F.col("__e") == sums["e"], "left")
    whole = F.col("low").isNotNull() & F.col("high").isNotNull()
    return out.select(*positions.columns, F.coalesce("__moves", F.lit(0)).cast("bigint").alias("moves"), F.coalesce("__points", F.lit(0)).cast("bigint").alias("points"), *[F.coalesce(F.when(whole, F.col(held)), F.lit(0.0)).alias(n) for n, held in names.items()])


def inventory_points(costs: dict[str, tuple[Column, Column]], before: str = "before", after: str = "price") -> tuple[Column, list[str]]:
    """Points and measures for ``range_sums`` from which ``inventory_cost`` gives each cost.

    costs: for each name the price at which a move's amounts are counted, and a weight of the move.
    A move puts its new price in and takes its old one out.
    """
    measures = [f"{name}_{part}" for name in costs for part in ("xr", "x", "yr", "y")]

    def point(price: str, sign: int) -> Column:
        root, cells = F.sqrt(F.col(price)), []
        for at, weight in costs.values():
            cells += [at * weight / root, at * weight, weight * root, weight]
        return F.struct(F.col(price).cast("double").alias("at"), *[(sign * c).cast("double").alias(m) for c, m in zip(cells, measures)])

    return F.when(F.col(before).isNotNull(), F.array(point(after, 1), point(before, -1))), measures


def inventory_cost(name: str) -> Column:
    """The cost for a liquidity of 1: -(price * change of amount0 + change of amount1), summed over the moves.

    The amounts of a range [low, high] are those below ``high`` less those below ``low``; a price
    above a bound counts as the bound. With the outside price this is the rebalancing cost, with
    the new price the convexity cost of a move.
    """
    # where no price reaches a bound, what rounding leaves of the sum must not meet a bound far away
    clipped = lambda part, b: F.when(F.col(f"points_{b}") == F.col("points"), F.lit(0.0)).otherwise(F.col(f"{name}_{part}_{b}"))
    x = {b: F.col(f"{name}_xr_{b}") - clipped("x", b) / F.sqrt(F.col(b)) for b in ("low", "high")}
    y = {b: F.col(f"{name}_yr_{b}") - clipped("y", b) * F.sqrt(F.col(b)) for b in ("low", "high")}
    return F.coalesce(-(x["high"] - x["low"] + y["high"] - y["low"]), F.lit(0.0))


def medoids(df: DataFrame, cells: list[str], features: list[str], key: str) -> DataFrame:
    """The row of each cell nearest its medians, in units of its interquartile ranges; a feature without spread is left out."""
    stats = df.groupBy(*cells).agg(F.count("*").alias("candidates"), *[F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__q_{f}") for f in features])
    rows = df.join(stats, cells)
    score = F.lit(0.0)
    for f in features:
        q = F.col(f"__q_{f}")
        spread = q[2] - q[0]
        score = score + F.when(spread > 0, F.pow((F.col(f) - q[1]) / F.nullif(spread, F.lit(0.0)), 2)).otherwise(0.0)
    best = rows.withColumn("medoid_score", score).groupBy(*cells, "candidates").agg(F.min(F.struct("medoid_score", key, *[c for c in df.columns if c not in {*cells, key}])).alias("b"))
    return best.select(*cells, "candidates", "b.*")
