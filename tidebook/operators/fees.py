"""Attributing collected amounts to positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators.ordered import asof_join, running_sums
from tidebook.util import entity_key

SUM = "decimal(38,0)"


def attribute_collections(pairs: DataFrame, pair: list[str], collects: DataFrame, identity: list[str], entry: str, exit_: str, scope: tuple[str, str], at: str, amounts: list[str], principals: list[str], width: int) -> DataFrame:
    """Amounts collected by each position's identity, split into interim ones and those of its exit.

    Order keys are whole numbers. ``scope`` names the first and last order key of the exit's
    transaction. Interim collections come after the entry and before that transaction; those of the
    exit in it, after the exit. One that is in the exit's transaction before the exit counts in
    neither. What the exit collects counts as a fee beyond the principals only, and only if it
    covers the principal of every amount; else the exit's fee is 0.

    Adds ``interim_count``, ``exit_count``, ``exit_covers_principal`` and for each amount
    ``interim_{amount}``, ``exit_{amount}`` and ``fee_{amount}``, in place of columns of these names. A position without collections
    has 0, null amounts and principals count as 0, and a null identity or key has no collections.

    Sums are differences of running sums of the identity's collections, looked up as of four keys,
    so no position meets its collections however many there are. ``width`` is that of the stretches
    in which collections are sorted.
    """
    values = {f"q{i}": F.coalesce(F.col(a).cast(SUM), F.lit(0).cast(SUM)) for i, a in enumerate(amounts)} | {"qn": F.lit(1).cast(SUM)}
    known = collects.filter(F.col(at).isNotNull())
    for c in identity:
        known = known.filter(F.col(c).isNotNull())
    known = known.select(entity_key(identity).alias("__i"), F.col(at).cast("bigint").alias("__k"), *[v.alias(f"{n}x") for n, v in values.items()])
    run = running_sums(known, "__k", [], {n: F.col(f"{n}x") for n in values}, width, by=["__i"]).select("__i", "__k", *values)

    whole = F.lit(True)
    for c in identity:
        whole &= F.col(c).isNotNull()
    probe = lambda name, key: F.struct(F.lit(name).alias("name"), key.cast("bigint").alias("t"))
    marks = F.array(probe("entry", F.col(entry) + 1), probe("before", F.col(scope[0])), probe("exit", F.col(exit_) + 1), probe("after", F.col(scope[1]) + 1))
    # the interim ends where it begins if the entry is in the exit's transaction
    live = pairs.filter(whole).select(entity_key(pair).alias("__p"), entity_key(identity).alias("__i"), (F.col(entry) < F.col(scope[0])).alias("__interim"), F.explode(marks).alias("x")).select("__p", "__i", "__interim", "x.*")
    seen = asof_join(live, run, "t", "__k", list(values), width, by=["__i"], tie="qn")
    part = lambda n, name: F.coalesce(F.max(F.when(F.col("name") == name, F.col(n))), F.lit(0).cast(SUM))
    cells = []
    for n in values:
        cells += [F.when(F.coalesce(F.first("__interim"), F.lit(False)), part(n, "before") - part(n, "entry")).otherwise(F.lit(0)).cast(SUM).alias(f"{n}i"), (part(n, "after") - part(n, "exit")).cast(SUM).alias(f"{n}e")]
    sums = seen.groupBy("__p").agg(*cells)
    got = pairs.withColumn("__p0", entity_key(pair)).join(sums, F.col("__p0") == F.col("__p"), "left")
    zero = F.lit(0).cast(SUM)
    held = lambda c: F.coalesce(F.col(c), zero)
    covered, out = F.lit(True), []
    for i, principal in enumerate(principals):
        covered &= held(f"q{i}e") >= held(principal).cast(SUM)
    for i, (amount, principal) in enumerate(zip(amounts, principals)):
        fee = held(f"q{i}i") + F.when(covered, held(f"q{i}e") - held(principal).cast(SUM)).otherwise(zero)
        out += [held(f"q{i}i").alias(f"interim_{amount}"), held(f"q{i}e").alias(f"exit_{amount}"), fee.cast(SUM).alias(f"fee_{amount}")]
    taken = {"interim_count", "exit_count", "exit_covers_principal", *[f"{x}_{a}" for a in amounts for x in ("interim", "exit", "fee")]}
    return got.select(*[c for c in pairs.columns if c not in taken], held("qni").cast("bigint").alias("interim_count"), held("qne").cast("bigint").alias("exit_count"), covered.alias("exit_covers_principal"), *out)
