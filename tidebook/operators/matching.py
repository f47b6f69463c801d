"""Sequential matchers: first-in-first-out pairs, nearest-preceding links, overlaps.

A walk goes up at an opening event and down at a closing one; its reflection at zero tells which
closings find an opening. A key's events are sorted only within stretches of the first order
column. What a stretch inherits (the walk, its minimum, counts) comes from a table with one row
for each key and stretch, so a key that holds a third of all events is spread over its stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.operators.ordered import stretch_of
from tidebook.util import entity_columns, entity_key

#: Default width of a stretch in units of the first order column.
WIDTH = 4_096
_FIRST = -(2**62)


def _placed(rows: DataFrame, key: list[str], order: str, width: int) -> DataFrame:
    """Add the key as one string and the stretch; a null order comes first."""
    return rows.withColumn("__e", entity_key(key)).withColumn("__w", F.coalesce(stretch_of(order, width), F.lit(_FIRST)))


def _inherited(rows: DataFrame, sums: dict[str, Column], lows: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Rows with sums over the key's earlier stretches.

    ``lows``: name -> (name of a sum, its lowest running value within a stretch); gives the lowest
    running value before the stretch, at most 0, and with ``_all`` that of the whole key. Sums with
    ``_all`` are those of the whole key.
    """
    lows = lows or {}
    totals = rows.groupBy("__e", "__w").agg(*[F.sum(c).alias(f"t{n}") for n, c in sums.items()], *[F.min(c).alias(f"l{n}") for n, (_, c) in lows.items()])
    every = Window.partitionBy("__e")
    earlier = every.orderBy("__w").rowsBetween(Window.unboundedPreceding, -1)
    at = totals.select("*", *[F.coalesce(F.sum(f"t{n}").over(earlier), F.lit(0)).alias(n) for n in sums], *[F.sum(f"t{n}").over(every).alias(f"{n}_all") for n in sums])
    reached = {n: F.col(base) + F.col(f"l{n}") for n, (base, _) in lows.items()}
    at = at.select("*", *[F.least(F.lit(0), F.coalesce(F.min(c).over(earlier), F.lit(0))).alias(n) for n, c in reached.items()], *[F.least(F.lit(0), F.min(c).over(every)).alias(f"{n}_all") for n, c in reached.items()])
    kept = [*sums, *lows]
    return rows.join(at.select("__e", "__w", *kept, *[f"{n}_all" for n in kept]), ["__e", "__w"])


def _walk(events: DataFrame, key: list[str], order: list[str], opens: str, width: int) -> DataFrame:
    """Events with ``__d`` (+1 or -1), the walk and its running minimum at each row (``__s``, ``__m``) and before it
    (``__s0``, ``__m0``), and ``__n`` and ``__o``: events and openings of the key so far, and of the whole key (``_all``)."""
    w = Window.partitionBy("__e", "__w").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = _placed(events, key, order[0], width).withColumn("__up", F.col(opens).cast("int")).withColumn("__d", 2 * F.col("__up") - 1)
    rows = rows.select("*", F.sum("__d").over(upto).alias("__ls"), F.row_number().over(w).alias("__ln"), F.sum("__up").over(upto).alias("__lo"))
    rows = rows.select("*", F.min("__ls").over(upto).alias("__lm"), F.min("__ls").over(before).alias("__lm0"))
    rows = _inherited(rows, {"__bs": F.col("__d"), "__bn": F.lit(1), "__bo": F.col("__up")}, {"__bm": ("__bs", F.col("__ls"))})
    lowest = lambda local: F.least("__bm", F.col("__bs") + F.coalesce(local, F.lit(0)))
    rows = rows.withColumns({"__s": F.col("__bs") + F.col("__ls"), "__n": F.col("__bn") + F.col("__ln"), "__o": F.col("__bo") + F.col("__lo"), "__m": lowest(F.col("__lm")), "__m0": lowest(F.col("__lm0"))})
    return rows.withColumn("__s0", F.col("__s") - F.col("__d"))


def fifo_pairs(events: DataFrame, key: list[str], order: list[str], opens: str, event: str, base: list[str] | None = None, carry: list[str] = (), width: int = WIDTH) -> DataFrame:
    """Pair each closing event with the earliest unpaired opening one of the same key before it.

    Result for every event: key, ``event``, order, ``carry``, ``is_matched``, ``pair_number``,
    ``candidate_count`` (unpaired openings that a matched closing had before it) and
    ``unmatched_reason`` ('no_preceding_open', 'no_subsequent_close' or null). With ``base``, a
    coarser key, ``base_position`` numbers all events of the base key, so that a pair whose
    positions are not neighbours has other events between them.
    Null parts of the key are values. The order must be total, and its first column a whole number.
    """
    kept = [*dict.fromkeys([*key, event, opens, *order, *(base or []), *carry])]
    rows = events.select(*kept)
    if base:
        rows = _placed(rows, base, order[0], width)
        rows = _inherited(rows.withColumn("__ln", F.row_number().over(Window.partitionBy("__e", "__w").orderBy(*order))), {"__bn": F.lit(1)})
        rows = rows.select(*kept, (F.col("__bn") + F.col("__ln")).alias("base_position"))
    rows = _walk(rows, key, order, opens, width)
    # the running minimum has fallen once for each closing that found nothing
    matched_close = ~F.col(opens) & (F.col("__m") == F.col("__m0"))
    number = F.when(F.col(opens), F.col("__o")).otherwise(F.col("__n") - F.col("__o") + F.col("__m"))
    closes = F.col("__bn_all") - F.col("__bo_all") + F.col("__bm_all")
    matched = F.when(F.col(opens), F.col("__o") <= closes).otherwise(matched_close)
    reason = F.when(~matched, F.when(F.col(opens), F.lit("no_subsequent_close")).otherwise(F.lit("no_preceding_open")))
    kept += ["base_position"] if base else []
    return rows.select(*kept, matched.alias("is_matched"), F.when(matched, number).cast("bigint").alias("pair_number"), F.when(matched_close, F.col("__s0") - F.col("__m0")).cast("bigint").alias("candidate_count"), reason.alias("unmatched_reason"))


def join_pairs(matched: DataFrame, key: list[str], opens: str, columns: list[str]) -> DataFrame:
    """One row a pair from ``fifo_pairs``: key, pair_number, candidate_count, and entry_/exit_ columns."""
    hit = matched.filter("is_matched")
    cells = [F.max(F.when(F.col(opens) == side, F.col(c))).alias(f"{name}_{c}") for side, name in ((True, "entry"), (False, "exit")) for c in columns]
    return hit.groupBy(*key, "pair_number").agg(F.max("candidate_count").alias("candidate_count"), *cells)


def nearest_links(events: DataFrame, key: list[str], order: list[str], opens: str, event: str, width: int = WIDTH) -> DataFrame:
    """Link each closing event to the nearest unlinked opening one before it (last in, first out).

    Result: key, ``open_{event}``, ``close_{event}``. A closing at the walk's depth l is linked to
    the last opening at depth l; openings and closings of a depth take turns, so that is the event
    of the depth before it. The order must be total, and its first column a whole number.
    """
    rows = _walk(events.select(*dict.fromkeys([*key, event, opens, *order])), key, order, opens, width)
    hit = F.col(opens) | (F.col("__m") == F.col("__m0"))
    depth = F.when(F.col(opens), F.col("__s") - F.col("__m")).otherwise(F.col("__s0") - F.col("__m0"))
    levelled = rows.filter(hit).select("__e", depth.alias("__l"), "__w", *order, F.struct(F.col(event).alias("v")).alias("__v"), F.col(opens).alias("__opens"))
    last = levelled.groupBy("__e", "__l", "__w").agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    last = last.select("__e", "__l", "__w", F.lag("__last").over(Window.partitionBy("__e", "__l").orderBy("__w")).alias("__before"))
    within = Window.partitionBy("__e", "__l", "__w").orderBy(*order)
    found = levelled.join(last, ["__e", "__l", "__w"]).withColumn("__p", F.coalesce(F.lag("__v").over(within), F.col("__before")))
    return found.filter("NOT __opens").select(*entity_columns("__e", key, events.schema), F.col("__p.v").alias(f"open_{event}"), F.col("__v.v").alias(f"close_{event}"))


def overlapping(intervals: DataFrame, identity: list[str], start: str, end: str, ties: list[str], width: int = WIDTH) -> DataFrame:
    """Intervals that overlap another of their identity; touching ones do not. Null identities are left out, null starts come first.

    ``start`` is a whole number.
    """
    rows = intervals
    for c in identity:
        rows = rows.filter(F.col(c).isNotNull())
    rows = _placed(rows, identity, start, width)
    ends = rows.groupBy("__e", "__w").agg(F.max(end).alias("__top"), F.min(start).alias("__low"))
    series = Window.partitionBy("__e").orderBy("__w")
    ends = ends.select("__e", "__w", F.max("__top").over(series.rowsBetween(Window.unboundedPreceding, -1)).alias("__reached"), F.lead("__low").over(series).alias("__later"))
    w = Window.partitionBy("__e", "__w").orderBy(start, *ties)
    rows = rows.join(ends, ["__e", "__w"])
    rows = rows.withColumn("__reach", F.greatest("__reached", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))).withColumn("__next", F.coalesce(F.lead(start).over(w), F.col("__later")))
    return rows.filter((F.col("__reach") > F.col(start)) | (F.col("__next") < F.col(end))).select(*intervals.columns)


def depth_mismatches(unmatched: DataFrame, base: list[str], opens: str, depth: str) -> DataFrame:
    """Unmatched events with an unmatched event of the other kind at another depth under the same base key (nulls are values).

    The depths of a base key are four numbers, aggregated before the shuffle.
    """
    rows = unmatched.withColumn("__e", entity_key(base))
    cells = [f(F.when(F.col(opens) == side, F.col(depth))).alias(f"__{name}_{side}") for name, f in (("lo", F.min), ("hi", F.max)) for side in (True, False)]
    rows = rows.join(rows.groupBy("__e").agg(*cells), "__e")
    other = lambda name: F.when(F.col(opens), F.col(f"__{name}_False")).otherwise(F.col(f"__{name}_True"))
    return rows.filter((other("lo") != F.col(depth)) | (other("hi") != F.col(depth))).select(*unmatched.columns)
