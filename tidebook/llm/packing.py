"""Filling fixed-capacity containers by swap-based local search.

Documents are dealt into blocks of bounded size. Each block is filled best fit first and then
improved: documents move, or are exchanged one for one or two for one, between underfull bins so
that the sum of squared fills rises, until the emptiest bin is empty or no exchange helps. Bins
that are still poorly filled are opened again and their documents go on to a block of the next
round, which joins the remains of many blocks, until one block for each kind of container is left.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.util import materialise

#: Documents dealt to a block of the first round, blocks joined in later rounds, and the fill below which a bin is opened again.
BLOCK_ROWS, FAN, GOOD_FILL = 8_192, 64, 0.98
#: Most steps of the local search in one block.
MOST_STEPS = 5_000
#: Most kinds of containers.
MOST_KINDS = 1_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers) by best fit in order of falling size."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(free, (sizes[item], -1))
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        bisect.insort(free, (left - sizes[item], b))
    return bins


def _gain(bins, fill, sizes, capacity, giver, pool, owner):
    """The exchange that carries most size from the giver to another underfull bin and raises the sum of squared fills.

    pool, owner: the items of the underfull bins and their bins. Returns (size carried, bin, items
    given, item taken back or None), or None. One item may move or be exchanged for a smaller one,
    or two go for one.
    """
    import numpy as np

    free = capacity - fill
    other = owner != giver
    pool, owner = pool[other], owner[other]
    takers = np.unique(owner)
    if not len(takers):
        return None
    least, room, pool_size = np.maximum(fill[giver] - fill[owner], 0), free[owner], sizes[pool]
    ones, twos = {}, {}
    for n, i in enumerate(bins[giver]):
        ones.setdefault(int(sizes[i]), (i,))
        for k in bins[giver][n + 1 :]:
            twos.setdefault(int(sizes[i] + sizes[k]), (i, k))
    best = (0, None, None, None)
    for size, items in ones.items():
        fits = takers[(free[takers] >= size) & (size > fill[giver] - fill[takers])]
        if size > best[0] and len(fits):
            best = (size, int(fits[np.argmin(free[fits])]), items, None)
    for size, items in [*ones.items(), *twos.items()]:
        if size <= best[0]:
            continue
        carried = size - pool_size
        carried[(carried > room) | (carried <= least)] = 0
        at = int(np.argmax(carried))
        if carried[at] > best[0]:
            best = (int(carried[at]), int(owner[at]), items, int(pool[at]))
    return best if best[1] is not None else None


def improve(bins: list[list[int]], sizes, capacity: int, most_steps: int = MOST_STEPS) -> list[list[int]]:
    """Local search between underfull bins, the emptiest giving first, until bins empty.

    Every step raises the sum of squared fills. The search ends when no step does, when as few
    bins are left as the total size allows, or after ``most_steps``; it only ever saves bins.
    """
    import numpy as np

    sizes = np.asarray(sizes, dtype=np.int64)
    least = max(1, -(-int(sizes.sum()) // capacity))
    bins = [list(b) for b in bins]
    fill = np.array([int(sizes[b].sum()) for b in bins], dtype=np.int64)
    for _ in range(most_steps):
        if len(bins) <= least:
            break
        givers = [int(b) for b in np.argsort(fill, kind="stable") if fill[b] < capacity]
        pool = np.array([i for b in givers for i in bins[b]], dtype=np.int64)
        owner = np.array([b for b in givers for _ in bins[b]], dtype=np.int64)
        step = None
        for giver in givers:
            if step := _gain(bins, fill, sizes, capacity, giver, pool, owner):
                break
        if step is None:
            break
        carried, taker, given, taken = step
        for i in given:
            bins[giver].remove(i)
            bins[taker].append(i)
        if taken is not None:
            bins[taker].remove(taken)
            bins[giver].append(taken)
        fill[giver] -= carried
        fill[taker] += carried
        if not fill[giver]:  # what is left there are empty documents; any bin takes them
            bins[taker] += bins[giver]
            del bins[giver]
            fill = np.delete(fill, giver)
    return bins


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of the items of one block."""
    return improve(best_fit(sizes, capacity), sizes, capacity) if sizes else []


ITEMS = "kind string, capacity int, block bigint, row bigint, piece int, tokens int, bin bigint, open boolean"


def _rounds(keep_all: bool):
    def run(batches: Iterable) -> Iterator:
        """Pack each (kind, block) of rows sorted by it; only one block is held at a time."""
        import numpy as np
        import pyarrow as pa

        def packed(t):
            sizes = t.column("tokens").to_numpy().astype(np.int64)
            capacity = t.column("capacity")[0].as_py()
            bins = pack(sizes.tolist(), capacity)
            number, fill = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(bins), dtype=np.int64)
            for b, items in enumerate(bins):
                number[items], fill[b] = b, sizes[items].sum()
            again = np.zeros(len(bins), dtype=bool) if keep_all else fill < GOOD_FILL * capacity
            t = t.append_column("bin", pa.array(number)).append_column("open", pa.array(again[number]))
            return t.to_batches()

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while True:
                kind, block = held.column("kind").combine_chunks().dictionary_encode().indices.to_numpy(), held.column("block").to_numpy()
                cuts = np.flatnonzero((np.diff(kind) != 0) | (np.diff(block) != 0))
                if not len(cuts):
                    break
                yield from packed(held.slice(0, int(cuts[0]) + 1))
                held = held.slice(int(cuts[0]) + 1)
        if held is not None and held.num_rows:
            yield from packed(held)

    return run


def pack_documents(sizes: DataFrame, capacities: DataFrame, doc: str, tokens: str, kind: str, capacity: str) -> DataFrame:
    """Assign every document to containers of each capacity.

    sizes: ``doc`` and its size ``tokens``. capacities: ``kind`` and its ``capacity``.
    Result: ``container_kind``, ``capacity_tokens``, ``container_id``, doc, ``piece``,
    ``token_start``, ``token_count``.

    A document larger than the capacity is cut into pieces that fill whole containers and a rest;
    any other stays whole (piece 0). Documents of size 0, or of null or negative size (taken as
    0), take no space and ride in some container. Repeated rows are documents of their own.
    Kinds without a positive capacity are left out; a kind listed twice has its smallest capacity.

    Blocks are dealt by a hash of the row, so no document or origin makes one larger than others;
    a piece that fills a container needs no block at all.
    """
    few = capacities.filter(F.col(capacity) > 0).groupBy(F.col(kind).cast("string").alias("kind")).agg(F.min(F.col(capacity).cast("int")).alias("capacity")).limit(MOST_KINDS + 1).collect()
    if len(few) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    size = F.greatest(F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)), F.lit(0))
    rows = materialise(sizes.select(F.col(doc).alias("doc"), size.alias("size"), F.monotonically_increasing_id().alias("row")), "pack-sizes")
    most = rows.count()
    kinds = F.array(*[F.struct(F.lit(r["kind"]).alias("kind"), F.lit(r["capacity"]).alias("capacity")) for r in few])
    wide = rows.select("doc", "row", "size", F.explode(kinds if few else F.array().cast("array<struct<kind:string,capacity:int>>")).alias("k")).select("doc", "row", "size", "k.*")
    wide = wide.withColumn("wholes", F.when(F.col("size") > F.col("capacity"), F.expr("size div capacity")).otherwise(F.lit(0)))
    wide = wide.withColumn("rest", F.col("size") - F.col("wholes") * F.col("capacity"))

    def named(df: DataFrame, name) -> DataFrame:
        return df.select(F.col("kind").alias("container_kind"), F.col("capacity").alias("capacity_tokens"), name.alias("container_id"), "doc", F.col("piece").cast("int").alias("piece"), (F.col("piece").cast("bigint") * F.col("capacity")).alias("token_start"), F.col("tokens").cast("int").alias("token_count"))

    full = wide.filter("wholes > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("wholes") - 1)).alias("piece")).withColumn("tokens", F.col("capacity"))
    out = named(full, F.concat_ws("-", "kind", F.lit("whole"), F.col("row").cast("string"), F.col("piece").cast("string")))

    blocks = max(1, -(-most // BLOCK_ROWS))
    items = wide.filter("rest > 0 OR wholes = 0").select("kind", "capacity", F.pmod(F.xxhash64("kind", "row"), F.lit(blocks)).alias("block"), "row", F.col("wholes").cast("int").alias("piece"), F.col("rest").cast("int").alias("tokens"))
    parts, number = [], 0
    while True:
        last = blocks == 1
        done = items.repartition(max(1, min(blocks * max(1, len(few)), 200_000)), "kind", "block").sortWithinPartitions("kind", "block").mapInArrow(_rounds(last), ITEMS)
        done = materialise(done, f"pack-round-{number}")
        parts.append(done.filter("NOT open").withColumn("container", F.concat_ws("-", "kind", F.lit(str(number)), F.col("block").cast("string"), F.col("bin").cast("string"))))
        if last:
            break
        blocks = -(-blocks // FAN)
        items = done.filter("open").select("kind", "capacity", F.expr(f"block div {FAN}").alias("block"), "row", "piece", "tokens")
        number += 1
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.unionByName(part)
    rest = placed.join(rows.select("row", "doc"), "row")
    return out.unionByName(named(rest, F.col("container"))).withColumnRenamed("doc", doc)


def fill_report(packed: DataFrame) -> DataFrame:
    """For each kind: containers, the least number that the total allows, tokens, and the share left unused."""
    each = packed.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"), F.count_distinct("container_id").alias("containers"), F.sum(F.col("token_count").cast("bigint")).alias("tokens"))
    space = F.col("containers") * F.col("capacity_tokens")
    return each.select("*", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), (1 - F.col("tokens") / space).alias("unused_share"))
