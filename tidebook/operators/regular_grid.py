"""Irregular readings onto a regular grid with a Kalman smoother, in parallel over time.

Model of a source's log price in time units of its grid step: a local trend in continuous time,
    level' = slope + sqrt(q) * white noise,   slope' = sqrt(q * TREND) * white noise,
and a reading is the level plus noise of variance r. q and r are estimated for each source from
the squared differences of readings one and two places apart, E[dz^2] = 2 r + q dt.

Sources are few and may be endless, so none is smoothed in one task. Time is cut into blocks of
BLOCK grid steps. What a block does to a state is an affine-Gaussian element (A, b, C, eta, J);
elements combine associatively. Each block's element is found by itself, elements are combined
in a tree of fan-in FAN, which gives each block the state that comes in from the past and the
information that comes back from the future, and each block is then smoothed by itself. The
outcome is that of one smoother over the whole series, not an approximation of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.util import materialise

BLOCK = 256
FAN = 128
#: Readings of one source within this part of a step become one reading at their mean time, of n-fold precision.
PARTS = 8
#: Differences of readings further apart than these steps tell nothing of the noise.
NEAR = 16
TREND = 1e-4
#: Variances no estimate may fall below, and the prior of the first state.
LEAST_Q, LEAST_R, PRIOR_LEVEL, PRIOR_SLOPE = 1e-12, 1e-12, 25.0, 1e-2
ELEMENT = ", ".join(f"x{i} double" for i in range(16))
CHUNK_ROWS = 400_000


def _motion(dt, q):
    """Transition and its noise over dt, for arrays of dt and q."""
    import numpy as np

    f = np.zeros((*dt.shape, 2, 2))
    f[..., 0, 0] = f[..., 1, 1] = 1
    f[..., 0, 1] = dt
    w = np.empty_like(f)
    s = q * TREND
    w[..., 0, 0] = q * dt + s * dt**3 / 3
    w[..., 0, 1] = w[..., 1, 0] = s * dt**2 / 2
    w[..., 1, 1] = s * dt
    return f, w


def _solve(m, right):
    """inverse(m) @ right for arrays of 2x2 matrices."""
    import numpy as np

    det = m[..., 0, 0] * m[..., 1, 1] - m[..., 0, 1] * m[..., 1, 0]
    inverse = np.empty_like(m)
    inverse[..., 0, 0], inverse[..., 1, 1] = m[..., 1, 1], m[..., 0, 0]
    inverse[..., 0, 1], inverse[..., 1, 0] = -m[..., 0, 1], -m[..., 1, 0]
    return (inverse / det[..., None, None]) @ right


def _turned(m):
    return m.swapaxes(-1, -2)


def _combine(first, then):
    """The element of two stretches of time, one after the other."""
    import numpy as np

    a1, b1, c1, e1, j1 = first
    a2, b2, c2, e2, j2 = then
    m = np.eye(2) + c1 @ j2
    side = np.eye(2) + j2 @ c1
    am = a2 @ _solve(m, np.broadcast_to(np.eye(2), m.shape))
    back = _turned(a1) @ _solve(side, np.broadcast_to(np.eye(2), side.shape))
    return am @ a1, am @ (b1 + c1 @ e2) + b2, am @ c1 @ _turned(a2) + c2, back @ (e2 - j2 @ b1) + e1, back @ j2 @ a1 + j1


def _carry(element, mean, cov):
    """The state after an element, from the state before it."""
    import numpy as np

    a, b, c, e, j = element
    m = a @ _solve(np.eye(2) + cov @ j, np.broadcast_to(np.eye(2), cov.shape))
    return m @ (mean + cov @ e) + b, m @ cov @ _turned(a) + c


def _flat(element):
    import numpy as np

    a, b, c, e, j = element
    n = a.shape[0]
    return np.concatenate([a.reshape(n, 4), b.reshape(n, 2), c.reshape(n, 4), e.reshape(n, 2), j.reshape(n, 4)], axis=1)


def _element(rows):
    return rows[:, 0:4].reshape(-1, 2, 2), rows[:, 4:6].reshape(-1, 2, 1), rows[:, 6:10].reshape(-1, 2, 2), rows[:, 10:12].reshape(-1, 2, 1), rows[:, 12:16].reshape(-1, 2, 2)


def _no_element(n):
    import numpy as np

    z = np.zeros((n, 2, 2))
    return np.broadcast_to(np.eye(2), (n, 2, 2)).copy(), np.zeros((n, 2, 1)), z, np.zeros((n, 2, 1)), z.copy()


def _whole_blocks(batches: Iterable) -> Iterator:
    """Tables of whole blocks from batches sorted by (s, k); the last block waits for the next batch."""
    import numpy as np
    import pyarrow as pa

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK_ROWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cuts = _cuts(t)
        at = int(cuts[-2])
        if at:
            yield t.slice(0, at)
        held, rows = t.slice(at).to_batches(), t.num_rows - at
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _cuts(t):
    """Where blocks begin in a table sorted by (s, k), and its length."""
    import numpy as np

    s = t.column("s").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    k = t.column("k").to_numpy()
    return np.concatenate([[0], np.flatnonzero((np.diff(s) != 0) | (np.diff(k) != 0)) + 1, [t.num_rows]])


def _padded(cuts, values, fill):
    """Rows of blocks as a matrix (block, place in the block)."""
    import numpy as np

    sizes = np.diff(cuts)
    out = np.full((len(sizes), max(1, int(sizes.max()))), fill, dtype=float)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(cuts[-1]) - np.repeat(cuts[:-1], sizes)] = values
    return out


def _block_elements(block_steps: int):
    """Each block's element. Rows: s, k, u (time in the block; null marks the block), z, n, q, r."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for t in _whole_blocks(batches):
            cuts = _cuts(t)
            u, z, n = (_padded(cuts, t.column(c).to_numpy(), np.nan) for c in ("u", "z", "n"))
            q, r = (t.column(c).to_numpy()[cuts[:-1]] for c in ("q", "r"))
            total, now = _no_element(len(q)), np.zeros(len(q))
            for i in range(u.shape[1]):
                live = np.flatnonzero(~np.isnan(z[:, i]))
                if not len(live):
                    continue
                f, w = _motion(u[live, i] - now[live], q[live])
                spread = w[:, 0, 0] + r[live] / n[live, i]
                gain = w[:, :, :1] / spread[:, None, None]
                seen = f[:, :1, :]  # H F
                value = z[live, i][:, None, None]
                step = (f - gain @ seen, gain * value, w - gain @ w[:, :1, :], _turned(seen) * (value / spread[:, None, None]), _turned(seen) @ seen / spread[:, None, None])
                for whole, part in zip(total, _combine(tuple(x[live] for x in total), step)):
                    whole[live] = part
                now[live] = u[live, i]
            f, w = _motion(block_steps - now, q)
            rest = list(_no_element(len(q)))
            rest[0], rest[2] = f, w
            flat = _flat(_combine(total, tuple(rest)))
            heads = t.select(["s", "k"]).take(pa.array(cuts[:-1]))
            for i in range(16):
                heads = heads.append_column(f"x{i}", pa.array(flat[:, i]))
            yield from heads.to_batches()

    return run


def _composed(key, pdf):
    """One element for a group of consecutive ones."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values("k")
    parts = _element(pdf[[f"x{i}" for i in range(16)]].to_numpy())
    total = tuple(x[:1] for x in parts)
    for i in range(1, len(pdf)):
        total = _combine(total, tuple(x[i : i + 1] for x in parts))
    return pd.DataFrame([[key[0], key[1], *_flat(total)[0]]], columns=["s", "k", *[f"x{i}" for i in range(16)]])


def _spread(key, pdf):
    """The incoming state and the returning information of each element of a group, from the group's own."""
    import numpy as np

    pdf = pdf.sort_values("k").reset_index(drop=True)
    parts = _element(pdf[[f"x{i}" for i in range(16)]].to_numpy())
    y = pdf.loc[0, [f"y{i}" for i in range(12)]].to_numpy(dtype=float)
    mean, cov, e, j = y[0:2].reshape(1, 2, 1), y[2:6].reshape(1, 2, 2), y[6:8].reshape(1, 2, 1), y[8:12].reshape(1, 2, 2)
    out = np.zeros((len(pdf), 12))
    for i in range(len(pdf)):
        out[i, :6] = np.concatenate([mean.ravel(), cov.ravel()])
        mean, cov = _carry(tuple(x[i : i + 1] for x in parts), mean, cov)
    for i in reversed(range(len(pdf))):
        out[i, 6:] = np.concatenate([e.ravel(), j.ravel()])
        nothing = (np.eye(2)[None], np.zeros((1, 2, 1)), np.zeros((1, 2, 2)), e, j)
        _, _, _, e, j = _combine(tuple(x[i : i + 1] for x in parts), nothing)
    for i in range(12):
        pdf[f"y{i}"] = out[:, i]
    return pdf[["s", "k", *[f"y{i}" for i in range(12)]]]


def _states(elements: DataFrame, priors: DataFrame, most: int, fan: int) -> DataFrame:
    """s, k, y0..y11 for each block: state at its start, information at its end."""
    up = [elements]
    while most > fan:
        below = up[-1].withColumn("g", F.floor(F.col("k") / fan))
        up.append(below.groupBy("s", "g").applyInPandas(_composed, f"s string, k bigint, {ELEMENT}"))
        most = -(-most // fan) + 1
    schema = "s string, k bigint, " + ", ".join(f"y{i} double" for i in range(12))
    known = up[-1].join(priors, "s").groupBy("s").applyInPandas(_spread, schema)
    for below in reversed(up[:-1]):
        groups = below.withColumn("g", F.floor(F.col("k") / fan)).join(known.withColumnRenamed("k", "g"), ["s", "g"])
        known = groups.groupBy("s", "g").applyInPandas(_spread, schema)
    return known


def _smoothed(block_steps: int):
    """Values of all grid slots of each block. Rows: s, k, u, z, n, usable, slot, volume, and on block marks q, r, y and the slots to give."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for t in _whole_blocks(batches):
            cuts = _cuts(t)
            marks, blocks = cuts[:-1], len(cuts) - 1
            block = np.repeat(np.arange(blocks), np.diff(cuts))
            u, z, n, slot, usable, volume = (t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("u", "z", "n", "slot", "usable", "volume"))
            q, r = (t.column(c).to_numpy(zero_copy_only=False)[marks] for c in ("q", "r"))
            y = np.stack([t.column(f"y{i}").to_numpy(zero_copy_only=False)[marks] for i in range(12)], axis=1)
            # events of each block in time: readings, grid times, and the block's end
            reading = np.flatnonzero(~np.isnan(z))
            at = np.concatenate([u[reading], np.tile(np.arange(block_steps + 1, dtype=float), blocks)])
            of = np.concatenate([block[reading], np.repeat(np.arange(blocks), block_steps + 1)])
            value = np.concatenate([z[reading], np.full(blocks * (block_steps + 1), np.nan)])
            noise = np.concatenate([r[block[reading]] / n[reading], np.ones(blocks * (block_steps + 1))])
            grid = np.concatenate([np.full(len(reading), -1.0), np.tile(np.arange(block_steps + 1, dtype=float), blocks)])
            order = np.lexsort((grid < 0, at, of))
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=blocks))])
            at, value, noise, grid = (_padded(ends, x[order], np.nan) for x in (at, value, noise, grid))
            steps = at.shape[1]
            live = ~np.isnan(at)
            mean, cov, now = y[:, 0:2].reshape(-1, 2, 1).copy(), y[:, 2:6].reshape(-1, 2, 2).copy(), np.zeros(blocks)
            means, covs, ahead, spread = [], [], [], []
            for i in range(steps):
                on = live[:, i]
                dt = np.where(on, at[:, i] - now, 0)
                now = np.where(on, at[:, i], now)
                f, w = _motion(dt, q)
                mean, cov = f @ mean, f @ cov @ _turned(f) + w
                ahead.append((f, mean))
                spread.append(cov)
                seen = on & ~np.isnan(value[:, i])
                if seen.any():
                    gain = np.where(seen, 1 / (cov[:, 0, 0] + np.where(seen, noise[:, i], 1)), 0)[:, None, None] * cov[:, :, :1]
                    mean = mean + gain * np.where(seen, value[:, i] - mean[:, 0, 0], 0)[:, None, None]
                    cov = cov - gain @ cov[:, :1, :]
                    cov = (cov + _turned(cov)) / 2
                means.append(mean)
                covs.append(cov)
            e, j = y[:, 6:8].reshape(-1, 2, 1), y[:, 8:12].reshape(-1, 2, 2)
            later = _solve(np.eye(2) + cov @ j, np.broadcast_to(np.eye(2), cov.shape))
            mean, cov = later @ (mean + cov @ e), later @ cov
            level, spreads = np.zeros((blocks, block_steps + 1)), np.zeros((blocks, block_steps + 1))
            every = np.arange(blocks)
            for i in reversed(range(steps)):
                if i < steps - 1:
                    f, guess = ahead[i + 1]
                    moved = live[:, i + 1] & (spread[i + 1][:, 1, 1] > 0)
                    gain = covs[i] @ _turned(f) @ _solve(spread[i + 1], np.broadcast_to(np.eye(2), cov.shape))
                    back = means[i] + gain @ (mean - guess), covs[i] + gain @ (cov - spread[i + 1]) @ _turned(gain)
                    mean, cov = (np.where(moved[:, None, None], b, now) for b, now in zip(back, (mean, cov)))
                here = live[:, i] & (grid[:, i] >= 0)
                level[every[here], grid[here, i].astype(int)] = mean[here, 0, 0]
                spreads[every[here], grid[here, i].astype(int)] = cov[here, 0, 0]
            # what was read in each slot
            known = np.flatnonzero(~np.isnan(slot))
            place = block[known] * block_steps + slot[known].astype(int)
            count = np.bincount(place, np.nan_to_num(usable[known]), minlength=blocks * block_steps)
            traded = np.bincount(place, np.nan_to_num(volume[known]), minlength=blocks * block_steps)
            with_volume = np.bincount(place, ~np.isnan(volume[known]), minlength=blocks * block_steps) > 0
            k = t.column("k").to_numpy()[marks]
            first, last = (t.column(c).to_numpy(zero_copy_only=False)[marks].astype(np.int64) for c in ("first", "last"))
            number = (k[:, None] * block_steps + np.arange(block_steps)[None, :]).ravel()
            wanted = np.flatnonzero((number >= np.repeat(first, block_steps)) & (number <= np.repeat(last, block_steps)))
            row = wanted // block_steps
            mid, sd = level[:, :block_steps].ravel()[wanted], np.sqrt(np.maximum(spreads[:, :block_steps].ravel()[wanted], 0))
            step = t.column("step").to_numpy(zero_copy_only=False)[marks].astype(np.int64)
            empty = np.isnan(y[row, 0]) | (t.column("readings").to_numpy(zero_copy_only=False)[marks][row] == 0)
            edge = np.minimum(1.96 * sd, 600)
            columns = [t.column("s").combine_chunks().take(pa.array(marks)).take(pa.array(row)), pa.array(number[wanted] * step[row])]
            with np.errstate(over="ignore"):
                columns += [pa.array(x, mask=empty) for x in (np.exp(np.minimum(mid, 700)), np.exp(np.clip(mid - edge, -700, 700)), np.exp(np.clip(mid + edge, -700, 700)), sd)]
            columns += [pa.array(count[wanted].astype(np.int64)), pa.array(traded[wanted], mask=~with_volume[wanted]), pa.array(count[wanted] == 0)]
            yield from pa.Table.from_arrays(columns, names=["s", "slot_epoch", "price", "price_low", "price_high", "log_sd", "readings", "volume", "is_missing"]).to_batches(max_chunksize=50_000)

    return run


def regular_grid(readings: DataFrame, sources: DataFrame, source: str, at: str, value: str, volume: str, version: str, step: str, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row for each grid step of each source, from its first to its last row's step.

    readings: ``source``, timestamp ``at``, ``value``, ``volume``, and ``version`` (the later of
    two readings of one source and instant holds). sources: ``source`` and its ``step`` in seconds.

    Result: source, ``slot_epoch`` (start of the step, seconds since 1970), ``price`` (smoothed,
    at the step's start), ``price_low`` and ``price_high`` (95 %), ``log_sd``, ``readings`` (usable
    rows in the step), ``volume`` (of the readings that hold; null if none has one), ``is_missing``
    (no usable row in the step; the price is then a filled value).

    A value is usable if it is not null, finite and above 0. A source none of whose values is
    usable has its steps, with null prices. Rows without a source or time have no place and are
    left out, as are sources without a positive step. Repeated rows count once in the smoother
    and each time in ``readings``.
    """
    v = F.col("v")
    usable = v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))
    steps = sources.filter((F.col(step) > 0) & F.col(source).isNotNull()).groupBy(F.col(source).cast("string").alias("s")).agg(F.min(F.col(step).cast("bigint")).alias("step"))
    rows = readings.filter(F.col(source).isNotNull() & F.col(at).isNotNull()).select(F.col(source).cast("string").alias("s"), F.unix_micros(at).alias("t"), F.col(value).cast("double").alias("v"), F.col(volume).cast("double").alias("volume"), F.unix_micros(version).alias("version"))
    # one row for each instant: the version that holds, and how many usable rows there were
    instants = rows.groupBy("s", "t").agg(F.max(F.struct("version", "v", "volume")).alias("held"), F.count(F.when(usable, 1)).alias("usable"))
    instants = instants.select("s", "t", "held.v", "held.volume", "usable").join(steps, "s")
    micros = F.col("step") * 1_000_000
    slot = F.expr("(t - pmod(t, step * 1000000)) div (step * 1000000)")
    inside = F.expr("pmod(t, step * 1000000)") / micros
    cells = instants.select("s", "step", slot.alias("slot"), inside.alias("inside"), F.when(usable, F.log("v")).alias("z"), "volume", "usable")
    cells = cells.groupBy("s", "step", "slot", F.floor(F.col("inside") * PARTS).alias("part")).agg(F.avg("z").alias("z"), F.count("z").alias("n"), F.avg(F.when(F.col("z").isNotNull(), F.col("inside"))).alias("inside"), F.sum("volume").alias("volume"), F.sum("usable").alias("usable"))
    cells = cells.select("s", "step", F.expr(f"(slot - pmod(slot, {block})) div {block}").alias("k"), F.expr(f"pmod(slot, {block})").alias("slot"), (F.expr(f"pmod(slot, {block})") + F.col("inside")).alias("u"), "z", "n", "volume", "usable")
    cells = materialise(cells, "grid-cells")

    # what each source is like: its span, its noise, its usual level
    pair = Window.partitionBy("s", "k").orderBy("u")
    place = F.col("k") * block + F.col("slot")
    moves = cells.filter("n > 0").select("s", "k", *[f(F.col(c) - F.lag(c, i).over(pair)).alias(f"{c}{i}") for i in (1, 2) for c, f in (("u", lambda x: x), ("z", lambda x: x * x))])
    close = {i: F.col(f"u{i}") <= NEAR for i in (1, 2)}
    noise = moves.groupBy("s").agg(*[F.avg(F.when(close[i], F.col(f"{c}{i}"))).alias(f"{c}{i}") for i in (1, 2) for c in "uz"])
    kinds = cells.groupBy("s", "step").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("z").alias("readings"), F.avg("z").alias("usual")).join(noise, "s", "left")
    usual_move = F.coalesce("z1", F.lit(1e-6))
    q = F.greatest(F.lit(LEAST_Q), F.coalesce((F.col("z2") - F.col("z1")) / F.nullif(F.col("u2") - F.col("u1"), F.lit(0.0)), F.lit(0.0)), usual_move / 1_000)
    kinds = kinds.withColumn("q", q).withColumn("r", F.greatest(F.lit(LEAST_R), (usual_move - F.col("q") * F.coalesce("u1", F.lit(1.0))) / 2, usual_move / 1_000))
    kinds = materialise(kinds.select("s", "step", "first", "last", "readings", "usual", "q", "r"), "grid-sources")
    marks = kinds.select("*", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))).alias("k"))
    none = F.lit(None).cast("double")
    inputs = cells.filter("n > 0").join(kinds.select("s", "q", "r"), "s").select("s", "k", "u", "z", F.col("n").cast("double").alias("n"), "q", "r").unionByName(marks.select("s", "k", none.alias("u"), none.alias("z"), none.alias("n"), "q", "r"))
    elements = materialise(inputs.repartition("s", "k").sortWithinPartitions("s", "k", "u").mapInArrow(_block_elements(block), f"s string, k bigint, {ELEMENT}"), "grid-elements")
    most = kinds.agg(F.max(F.floor(F.col("last") / block) - F.floor(F.col("first") / block) + 1)).first()[0] or 0
    prior = [F.coalesce("usual", F.lit(0.0)), F.lit(0.0), F.lit(PRIOR_LEVEL), F.lit(0.0), F.lit(0.0), F.lit(PRIOR_SLOPE), *[F.lit(0.0)] * 6]
    states = _states(elements, kinds.select("s", *[p.alias(f"y{i}") for i, p in enumerate(prior)]), most, fan)

    names = ["s", "k", "u", "z", "n", "slot", "usable", "volume", "q", "r", "first", "last", "step", "readings", *[f"y{i}" for i in range(12)]]
    marks = marks.join(states, ["s", "k"])
    everything = marks.unionByName(cells.select("s", "k", "u", "z", F.when(F.col("n") > 0, F.col("n").cast("double")).alias("n"), F.col("slot").cast("double").alias("slot"), F.col("usable").cast("double").alias("usable"), "volume"), allowMissingColumns=True).select(*names)
    # a block's mark comes first
    out = everything.repartition("s", "k").sortWithinPartitions("s", "k", F.col("q").isNull(), "u").mapInArrow(_smoothed(block), "s string, slot_epoch bigint, price double, price_low double, price_high double, log_sd double, readings bigint, volume double, is_missing boolean")
    return out.withColumnRenamed("s", source)
