"""Percentiles of very large columns from mergeable sketches of weighted, equal-size sorted buffers.

A sketch holds at most one full buffer of ``size`` values for each level; a value of level l
stands for 2**l values. Two full buffers of one level collapse into one of the next: their values
are merged in order and every second one is kept. A collapse of level l moves a rank by at most
2**l, upwards if it keeps the even positions and downwards if it keeps the odd ones. The two
alternate, and both sums are kept, so each sketch knows a bound on its own error. Buffers of one
level only ever meet each other, which makes the collapses a balanced tree: n values cost about
log2(n / size) levels and an error of at most about n * levels / (4 * size) ranks, whatever the
order of the data and however it was split into sketches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.util import entity_columns, entity_key

SIZE = 1_024
#: Sketches of one input partition are handed on when they hold this many bytes.
HELD_BYTES = 64 << 20
FAN_IN = 64


class Sketch:
    """Buffer-collapsing quantile sketch. Values must be finite."""

    HEAD = "<iqqqi"

    def __init__(self, size: int = SIZE):
        import numpy as np

        self.size, self.n, self.over, self.under = size, 0, 0, 0
        self.tail, self.full, self.odd = np.zeros(0), {}, {}

    def add(self, values) -> None:
        """Add an array of values."""
        import numpy as np

        self.n += len(values)
        rest = np.concatenate([self.tail, values]) if len(self.tail) else np.asarray(values, dtype=float)
        whole = len(rest) // self.size * self.size
        for at in range(0, whole, self.size):
            self._push(np.sort(rest[at : at + self.size]), 0)
        self.tail = rest[whole:].copy()

    def merge(self, other: Sketch) -> None:
        """Add another sketch of the same buffer size."""
        if other.size != self.size:
            raise ValueError("sketches of different buffer sizes do not merge")
        self.over += other.over
        self.under += other.under
        full, held = sum(self.size << level for level in other.full), other.n
        for level in sorted(other.full):
            self._push(other.full[level], level)
        self.n += full
        self.add(other.tail)
        if held != full + len(other.tail):
            raise ValueError("broken sketch")

    def _push(self, buffer, level: int) -> None:
        import numpy as np

        while level in self.full:
            merged = np.sort(np.concatenate([self.full.pop(level), buffer]))
            odd = self.odd.get(level, 0)
            self.odd[level] = 1 - odd
            if odd:
                self.under += 1 << level
            else:
                self.over += 1 << level
            buffer, level = merged[odd::2], level + 1
        self.full[level] = buffer

    @property
    def rank_error(self) -> float:
        """A bound on the error of any rank, as a share of n; 0 while nothing has collapsed."""
        return max(self.over, self.under) / self.n if self.n else 0.0

    def quantiles(self, probabilities: list[float]) -> list[float | None]:
        """Linear interpolation between the two values around rank p * (n - 1); None if empty."""
        import numpy as np

        if not self.n:
            return [None] * len(probabilities)
        values = np.concatenate([self.tail, *self.full.values()])
        weights = np.concatenate([np.ones(len(self.tail), dtype=np.int64), *[np.full(self.size, 1 << level, dtype=np.int64) for level in self.full]])
        order = np.argsort(values, kind="stable")
        values, reach = values[order], np.cumsum(weights[order])
        rank = np.asarray(probabilities, dtype=float) * (self.n - 1)
        low = np.floor(rank)
        below, above = (values[np.searchsorted(reach, np.minimum(x, self.n - 1), side="right")] for x in (low, low + 1))
        part = rank - low
        # a sum of two products, as the difference of two huge values could overflow
        return [float(x) for x in np.where(part == 0, below, below * (1 - part) + above * part)]

    def to_bytes(self) -> bytes:
        import numpy as np

        out = [struct.pack(self.HEAD, self.size, self.n, self.over, self.under, len(self.full)), struct.pack("<i", len(self.tail)), self.tail.astype("<f8").tobytes()]
        out += [struct.pack("<ii", level, self.odd.get(level, 0)) + np.asarray(self.full[level]).astype("<f8").tobytes() for level in sorted(self.full)]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Sketch:
        import numpy as np

        size, n, over, under, levels = struct.unpack_from(cls.HEAD, raw)
        at = struct.calcsize(cls.HEAD)
        out = cls(size)
        out.n, out.over, out.under = n, over, under
        (length,) = struct.unpack_from("<i", raw, at)
        out.tail = np.frombuffer(raw, "<f8", length, at + 4).copy()
        at += 4 + 8 * length
        for _ in range(levels):
            level, odd = struct.unpack_from("<ii", raw, at)
            out.full[level], out.odd[level] = np.frombuffer(raw, "<f8", size, at + 8), odd
            at += 8 + 8 * size
        return out

    def held_bytes(self) -> int:
        return 200 + 8 * (len(self.tail) + self.size * len(self.full))


def _packed(sketches: dict) -> Iterator:
    import pyarrow as pa

    from pyspark import TaskContext

    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    keys = list(sketches)
    for at in range(0, len(keys), 1_000):
        some = keys[at : at + 1_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([part] * len(some), pa.int32()), pa.array([sketches[k].to_bytes() for k in some], pa.binary())], names=["e", "part", "sketch"])


def _builder(size: int):
    def build(batches: Iterable) -> Iterator:
        import numpy as np

        held: dict = {}
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            code, value = keys.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order])) + 1
            names = keys.dictionary.to_pylist()
            for some in np.split(order, cuts):
                if len(some):
                    held.setdefault(names[code[some[0]]], Sketch(size)).add(value[some])
            if len(held) * 8 * size > HELD_BYTES and sum(s.held_bytes() for s in held.values()) > HELD_BYTES:
                yield from _packed(held)
                held = {}
        yield from _packed(held)

    return build


def _merger(batches: Iterable) -> Iterator:
    """Merge the sketches of one entity; they come sorted by entity."""
    import pyarrow as pa

    name, sketch = None, None
    out: list = []

    def pack(rows: list):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["e", "part", "sketch"])

    for batch in batches:
        for e, part, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            other = Sketch.from_bytes(raw)
            if (e, part) == name:
                sketch.merge(other)
                continue
            if name:
                out.append((*name, sketch.to_bytes()))
                if len(out) >= 500:
                    yield pack(out)
                    out = []
            name, sketch = (e, part), other
    if name:
        out.append((*name, sketch.to_bytes()))
    if out:
        yield pack(out)


def quantile_sketches(df: DataFrame, keys: list[str], value: str, size: int = SIZE) -> DataFrame:
    """One sketch for each group: e (see ``entity_key``), sketch.

    Null, NaN and infinite values are left out; a group without any other has no sketch. Each
    input partition sends one sketch a group, not its values, so a group that holds a third of all
    rows is as even as any.
    """
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(entity_key(keys).alias("e"), v.alias("v"))
    return merge_sketches(rows.mapInArrow(_builder(size), "e string, part int, sketch binary"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Combine the sketches of equal e, as from separate partitions, days or files.

    The merge is a tree of two levels, so no task takes more than a 64th of a group's sketches first.
    Sketches meet in an order of their own content, so the outcome does not depend on arrival.
    """
    parts = sketches if "part" in sketches.columns else sketches.withColumn("part", F.abs(F.xxhash64("sketch") % 1_000_000).cast("int"))
    schema = "e string, part int, sketch binary"
    near = parts.select("e", (F.col("part") % FAN_IN).alias("part"), "sketch")
    near = near.repartition("e", "part").sortWithinPartitions("e", "part", F.xxhash64("sketch")).mapInArrow(_merger, schema)
    whole = near.select("e", F.lit(0).alias("part"), "sketch").repartition("e").sortWithinPartitions("e", F.xxhash64("sketch")).mapInArrow(_merger, schema)
    return whole.select("e", "sketch")


def sketch_quantiles(sketches: DataFrame, probabilities: list[float]) -> DataFrame:
    """e, n, rank_error (bound, as a share of n) and ``quantiles`` (array in the order asked for)."""

    def read(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [Sketch.from_bytes(raw) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.n for s in found], pa.int64()), pa.array([s.rank_error for s in found], pa.float64()), pa.array([s.quantiles(probabilities) for s in found], pa.list_(pa.float64()))], names=["e", "n", "rank_error", "quantiles"])

    return sketches.select("e", "sketch").mapInArrow(read, "e string, n bigint, rank_error double, quantiles array<double>")


def group_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], size: int = SIZE) -> DataFrame:
    """keys, n, rank_error and quantiles of each group's finite values."""
    found = sketch_quantiles(quantile_sketches(df, keys, value, size), probabilities)
    return found.select(*entity_columns("e", keys, df.schema), "n", "rank_error", "quantiles")
