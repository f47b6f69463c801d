"""Overlapping and gapped intervals, as compressed run bitmaps by entity and shard.

Time is a whole number of units. The high bits of a unit name its shard, the low ones a position
in the shard's bitmap. Shards that an interval fills wholly are not written one by one: they are
units of the next level, whose shards are filled in the same way. An interval so costs a few
pieces whatever its length. A bitmap is kept as its runs, two unsigned 16-bit numbers each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.util import entity_columns, entity_key, materialise, partitions_for

BITS = 16
LEVELS = 4
#: Bounds beyond this are taken as this.
FARTHEST = 2**61
#: Rows gathered for one pass of the union, and units of a stretch within which runs are stitched.
CHUNK_ROWS = 262_144
STRETCH_BITS = 20
BITMAP = "e string, level int, shard bigint, runs binary"


def _pieces(rows: DataFrame) -> DataFrame:
    """e, level, shard, lo, hi: pieces that cover each row's [a, b) once.

    Each level is a projection of its own, so that its bounds are computed once.
    """
    found = []
    for level in range(LEVELS):
        rows = rows.withColumn("up", F.shiftright("a", BITS) + F.when(F.col("a").bitwiseAND(F.lit(2**BITS - 1)) != 0, 1).otherwise(0)).withColumn("down", F.shiftright("b", BITS))
        rows = rows.withColumn(f"h{level}", F.struct(F.col("a").alias("lo"), F.least("b", F.shiftleft("up", BITS)).alias("hi")))
        rows = rows.withColumn(f"t{level}", F.when(F.col("up") <= F.col("down"), F.struct(F.shiftleft("down", BITS).alias("lo"), F.col("b").alias("hi"))))
        rows = rows.withColumns({"a": F.when(F.col("up") < F.col("down"), F.col("up")), "b": F.when(F.col("up") < F.col("down"), F.col("down"))})
        found += [F.struct(F.lit(level).alias("level"), F.col(f"{x}{level}.lo"), F.col(f"{x}{level}.hi")) for x in "ht"]
    pieces = rows.select("e", F.explode(F.array(*found)).alias("p")).select("e", "p.*").filter("lo < hi")
    shard = F.shiftright("lo", BITS)
    return pieces.select("e", "level", shard.alias("shard"), (F.col("lo") - F.shiftleft(shard, BITS)).cast("int").alias("lo"), (F.col("hi") - F.shiftleft(shard, BITS)).cast("int").alias("hi"))


def _codes(table, names: list[str]):
    """A number for each row's tuple of the named columns; equal numbers for equal tuples."""
    import numpy as np

    code = np.zeros(table.num_rows, dtype=np.int64)
    for name in names:
        column = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    return code


def _union(group, lo, hi):
    """Runs of the union of [lo, hi) within each group; group, lo, hi and the row that began each run."""
    import numpy as np

    order = np.lexsort((lo, group))
    base = group[order] << (BITS + 1)
    start, end = base + lo[order], np.maximum.accumulate(base + hi[order])
    new = np.ones(len(order), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(order)) - 1
    return order[at], start[at] - base[at], end[last] - base[at]


def _runs(column):
    """Row number, lo and hi of all runs in a column of bitmaps."""
    import numpy as np

    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = np.array([len(x) for x in flat.to_pylist()], dtype=np.int64) // 4 if len(flat) else np.zeros(0, dtype=np.int64)
    pairs = np.frombuffer(b"".join(flat.to_pylist()), dtype="<u2").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(flat)), sizes), pairs[:, 0], pairs[:, 1] + 1


def _bitmaps(table, row, lo, hi):
    """A table of one bitmap for each (e, level, shard) from pieces that point to rows of ``table``."""
    import numpy as np
    import pyarrow as pa

    code = _codes(table, ["e", "level", "shard"])[row]
    at, lo, hi = _union(code, lo, hi)
    group = code[at]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, dtype=np.int64)
    pairs = np.stack([lo, hi - 1], axis=1).astype("<u2").tobytes()
    offsets = np.append(first, len(group)).astype(np.int32) * 4
    kept = table.select(["e", "level", "shard"]).take(pa.array(row[at[first]]))
    runs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs)])
    return kept.append_column("runs", runs)


def _gathered(batches: Iterable) -> Iterator:
    import pyarrow as pa

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _from_pieces(batches: Iterable) -> Iterator:
    import numpy as np

    for t in _gathered(batches):
        lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
        yield from _bitmaps(t, np.arange(t.num_rows), lo, hi).to_batches()


def _from_sorted(batches: Iterable) -> Iterator:
    """Union of bitmaps that come sorted by (e, level, shard): the last group waits for the next chunk, as one bitmap."""
    import pyarrow as pa

    waiting = None
    for t in _gathered(batches):
        t = t.select(["e", "level", "shard", "runs"])
        if waiting is not None:
            t = pa.concat_tables([waiting, t.cast(waiting.schema)])
        merged = _bitmaps(t, *_runs(t.column("runs")))
        code = _codes(pa.concat_tables([merged.select(["e", "level", "shard"]), t.select(["e", "level", "shard"]).slice(t.num_rows - 1)]), ["e", "level", "shard"])
        last = code[:-1] == code[-1]
        waiting = merged.filter(pa.array(last))
        yield from merged.filter(pa.array(~last)).to_batches()
    if waiting is not None:
        yield from waiting.to_batches()


def run_bitmaps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """One run bitmap for each (entity, level, shard): the union of the entity's [start, end) there.

    Intervals with a null bound or an end not after the start cover nothing. The entity is
    ``e`` (see ``entity_key``; nulls in keys are values). Union first happens on the map side,
    so a shard that holds a third of all rows reaches its task as some bitmaps of at most 128 kB
    for each input chunk.
    """
    clamp = lambda c: F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.col(c).cast("bigint")))
    usable = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    rows = usable.select(entity_key(keys).alias("e"), clamp(start).alias("a"), clamp(end).alias("b")).filter("a < b")
    parts = _pieces(rows).mapInArrow(_from_pieces, BITMAP)
    return parts.repartition(partitions_for(intervals, 32 << 20), "e", "level", "shard").sortWithinPartitions("e", "level", "shard").mapInArrow(_from_sorted, BITMAP)


def set_runs(bitmaps: DataFrame) -> DataFrame:
    """The set runs of all bitmaps in units of level 0: e, start, end. Runs of different shards may touch or overlap."""
    def decode(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            row, lo, hi = _runs(batch.column(batch.schema.get_field_index("runs")))
            level = batch.column(1).to_numpy().astype(np.int64)[row] * BITS
            base = batch.column(2).to_numpy()[row] << BITS
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array((base + lo) << level), pa.array((base + hi) << level)], names=["e", "a", "b"])

    return bitmaps.select("e", "level", "shard", "runs").mapInArrow(decode, "e string, a bigint, b bigint")


def periods_and_gaps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Continuous covered periods of each entity and the gaps between neighbouring ones.

    Result: keys, ``span_kind`` ('period' or 'gap'), ``span_start``, ``span_end`` (end excluded).
    Touching intervals join. Repeated rows change nothing; an entity without a usable interval
    has no rows; there is no gap before the first or after the last period.

    Runs are stitched within stretches of 2**20 units; what reaches into a stretch from before is
    known from the greatest ends of earlier stretches, so one entity's runs need not be in one task.
    """
    bitmaps = materialise(run_bitmaps(intervals, keys, start, end), "run-bitmaps")
    runs = set_runs(bitmaps).select("e", "a", "b", F.shiftright("a", STRETCH_BITS).alias("w"))
    ends = runs.groupBy("e", "w").agg(F.max("b").alias("top"))
    by = Window.partitionBy("e").orderBy("w")
    ends = ends.select("e", "w", F.max("top").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("reach"), F.max("top").over(Window.partitionBy("e")).alias("last"))
    within = Window.partitionBy("e", "w").orderBy("a", "b")
    seen = runs.join(ends, ["e", "w"]).select("e", "w", "a", "last", F.greatest("reach", F.max("b").over(within.rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    heads = materialise(seen.filter(F.col("before").isNull() | (F.col("a") > F.col("before"))), "period-heads")
    # a period ends where the next head's clear run begins; the next head may lie in a later stretch
    nexts = heads.groupBy("e", "w").agg(F.min_by("before", "a").alias("first_before"))
    nexts = nexts.select("e", "w", F.lead("first_before").over(by).alias("later"))
    heads = heads.join(nexts, ["e", "w"]).select("e", "a", "before", F.coalesce(F.lead("before").over(Window.partitionBy("e", "w").orderBy("a")), "later", "last").alias("z"))
    period = F.struct(F.lit("period").alias("span_kind"), F.col("a").alias("span_start"), F.col("z").alias("span_end"))
    gap = F.when(F.col("before").isNotNull(), F.struct(F.lit("gap").alias("span_kind"), F.col("before").alias("span_start"), F.col("a").alias("span_end")))
    spans = heads.select("e", F.explode(F.array_compact(F.array(period, gap))).alias("s"))
    return spans.select(*entity_columns("e", keys, intervals.schema), "s.*")
