"""Running balances of wide integers per entity, without one task for one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.functions.wideint import LIMBS, SUM, sign_of
from tidebook.util import entity_columns, entity_key

#: Width in units of the leading order column of the stretches in which an entity's rows are sorted.
STRETCH = 4_096


def last_rises(moves: DataFrame, keys: list[str], order: list[str], limbs: list[str], opens: str, carry: list[str], stretch: int = STRETCH) -> DataFrame:
    """Entities whose balance is above 0 at the end, with the row that last took it above 0.

    moves: rows with the entity's ``keys``, a total ``order`` (the first column is a bigint), the
    signed ``limbs`` of the move, and a boolean ``opens`` that says which rows may open.
    Result: keys and the opening row's ``carry`` columns.

    A row opens if the balance was 0 or less before it and is above 0 after it. Balances are
    exact to 84 digits. An entity's rows are sorted only within stretches of the first order
    column; stretch totals (few for each entity) are added up first, so that an entity with a
    third of all rows is spread over its stretches. Rows with null order columns come first.
    """
    schema = moves.schema
    rows = moves.select(entity_key(keys).alias("e"), F.coalesce(F.expr(f"`{order[0]}` div {stretch}"), F.lit(-1)).alias("w"), F.struct(*order, *[c for c in carry if c not in order]).alias("at"), F.col(opens).alias("opens"), *[F.col(c).alias(f"d{i}") for i, c in enumerate(limbs)])
    every = range(LIMBS)
    totals = rows.groupBy("e", "w").agg(*[F.sum(f"d{i}").cast(SUM).alias(f"b{i}") for i in every])
    earlier = Window.partitionBy("e").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("e", "w", *[F.coalesce(F.sum(f"b{i}").over(earlier), F.lit(0)).cast(SUM).alias(f"b{i}") for i in every])
    within = Window.partitionBy("e", "w").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(starts, ["e", "w"])
    run = run.select("e", "at", "opens", *[f"d{i}" for i in every], *[(F.col(f"b{i}") + F.sum(f"d{i}").over(within)).cast(SUM).alias(f"a{i}") for i in every])
    after, before = sign_of([F.col(f"a{i}") for i in every]), sign_of([F.col(f"a{i}") - F.col(f"d{i}") for i in every])
    opened = run.groupBy("e").agg(F.max(F.when(F.col("opens") & (after > 0) & (before <= 0), F.col("at"))).alias("at"))
    final = totals.groupBy("e").agg(*[F.sum(f"b{i}").cast(SUM).alias(f"b{i}") for i in every]).filter(sign_of([F.col(f"b{i}") for i in every]) > 0).select("e")
    return opened.join(final, "e").select(*entity_columns("e", keys, schema), *[F.col(f"at.{c}").alias(c) for c in carry])
