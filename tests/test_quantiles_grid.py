import math
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from tidebook.operators import regular_grid as grid
from tidebook.operators.quantiles import Sketch, group_quantiles, merge_sketches, quantile_sketches, sketch_quantiles


@pytest.mark.parametrize("shape", ["sorted", "random", "ties"])
def test_rank_error_stays_within_its_bound(shape):
    rng = np.random.default_rng(1)
    values = {"sorted": np.arange(60_000.0), "random": rng.standard_cauchy(60_000), "ties": rng.integers(0, 5, 60_000).astype(float)}[shape]
    parts = []
    for piece in np.array_split(values, 13):
        s = Sketch(256)
        s.add(piece)
        parts.append(Sketch.from_bytes(s.to_bytes()))
    whole = parts[0]
    for other in parts[1:]:
        whole.merge(other)
    assert whole.n == len(values) and 0 < whole.rank_error < 0.02
    ordered = np.sort(values)
    for p in (0.0, 0.01, 0.25, 0.5, 0.9, 1.0):
        v = whole.quantiles([p])[0]
        low, high = np.searchsorted(ordered, v, "left"), np.searchsorted(ordered, v, "right")
        slack = (whole.rank_error + 2 / 256) * len(values)
        assert low - slack <= p * (len(values) - 1) <= high + slack


def test_small_groups_are_exact_and_odd_values_left_out(spark):
    rng = random.Random(2)
    rows = [("a" if i % 3 else None, rng.choice([rng.random(), 1e308, -1e308, None, float("nan"), float("inf")]), 1) for i in range(400)] + [("empty", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, e int").repartition(6)
    out = {r["g"]: r for r in group_quantiles(df, ["g"], "v", [0.1, 0.5]).collect()}
    assert set(out) == {"a", None}
    for g, r in out.items():
        ok = [v for x, v, _ in rows if x == g and v is not None and math.isfinite(v)]
        assert r["n"] == len(ok) and r["rank_error"] == 0
        half = sorted(ok)
        k = 0.5 * (len(ok) - 1)
        want = half[int(k)] * (1 - k % 1) + half[min(int(k) + 1, len(ok) - 1)] * (k % 1)
        assert r["quantiles"][1] == pytest.approx(want, rel=1e-12)
    assert group_quantiles(df.filter("g = 'none'"), ["g"], "v", [0.5]).count() == 0


def test_sketches_of_separate_days_combine(spark):
    df = spark.range(40_000).selectExpr("'g' g", "cast(id % 10007 as double) v")
    days = [quantile_sketches(df.filter(f"v % 4 = {i}"), ["g"], "v", 512) for i in range(4)]
    union = days[0].union(days[1]).union(days[2]).union(days[3])
    r = sketch_quantiles(merge_sketches(union), [0.5]).first()
    assert r["n"] == 40_000 and r["quantiles"][0] == pytest.approx(5_000, abs=10_007 * (r["rank_error"] + 0.005))


def plain_smoother(times, logs, at, q, r, prior):
    """Filter and backward pass over one sorted series, reading by reading."""
    events = sorted([(t, 1, z) for t, z in zip(times, logs)] + [(t, 0, None) for t in at])
    mean, cov, now, kept = np.array([prior, 0.0]), np.diag([grid.PRIOR_LEVEL, grid.PRIOR_SLOPE]), 0.0, []
    s = q * grid.TREND
    for t, seen, z in events:
        dt, now = t - now, t
        f = np.array([[1, dt], [0, 1]])
        guess, spread = f @ mean, f @ cov @ f.T + np.array([[q * dt + s * dt**3 / 3, s * dt**2 / 2], [s * dt**2 / 2, s * dt]])
        mean, cov = guess, spread
        if seen:
            gain = spread[:, 0] / (spread[0, 0] + r)
            mean, cov = guess + gain * (z - guess[0]), spread - np.outer(gain, spread[0])
        kept.append((f, guess, spread, mean, cov))
    found = {}
    for i in reversed(range(len(events))):
        _, _, _, m, c = kept[i]
        if i + 1 < len(events):
            f, guess, spread, _, _ = kept[i + 1]
            if np.linalg.det(spread) > 0:
                gain = c @ f.T @ np.linalg.inv(spread)
                m, c = m + gain @ (mean - guess), c + gain @ (cov - spread) @ gain.T
            else:
                m, c = mean, cov
        mean, cov = m, c
        if not events[i][1]:
            found[events[i][0]] = (m[0], c[0, 0])
    return np.array([found[t] for t in at]).T


@pytest.mark.parametrize(("block", "fan"), [(8, 3), (256, 128)])
def test_blocks_give_the_smoother_of_the_whole_series(spark, block, fan):
    rng, start, step = random.Random(3), datetime(2024, 1, 1, tzinfo=timezone.utc), 10
    rows, level = [], 100.0
    for i in range(200):
        if 60 < i < 110:
            continue
        level *= math.exp(rng.gauss(0, 0.01))
        rows.append(("f", start + timedelta(seconds=step * i + rng.random() * 9), level * math.exp(rng.gauss(0, 0.002)), 1.0, start))
    df = spark.createDataFrame(rows, "feed string, at timestamp, price double, volume double, seen timestamp")
    feeds = spark.createDataFrame([("f", step)], "feed string, step int")
    out = sorted(grid.regular_grid(df, feeds, "feed", "at", "price", "volume", "seen", "step", block, fan).collect(), key=lambda r: r["slot_epoch"])
    assert [r["slot_epoch"] for r in out] == list(range(out[0]["slot_epoch"], out[-1]["slot_epoch"] + 1, step))
    assert sum(r["is_missing"] for r in out) == 49
    spread = [r["log_sd"] for r in out]
    assert max(spread) == max(spread[61:110]) > 3 * min(spread)
    # the model's parameters as the operator estimates them, and its origin of time
    origin = (out[0]["slot_epoch"] // step) // block * block
    u = np.array([r[1].timestamp() / step - origin for r in rows])
    z = np.log([r[2] for r in rows])
    def moments(gap):
        near = [(u[i + gap] - u[i], (z[i + gap] - z[i]) ** 2) for i in range(len(u) - gap) if u[i + gap] - u[i] <= grid.NEAR and int(u[i + gap] + origin) // block == int(u[i] + origin) // block]
        return np.mean(near, axis=0)

    (t1, z1), (t2, z2) = moments(1), moments(2)
    q = max(grid.LEAST_Q, (z2 - z1) / (t2 - t1), z1 / 1_000)
    r = max(grid.LEAST_R, (z1 - q * t1) / 2, z1 / 1_000)
    at = np.array([x["slot_epoch"] / step - origin for x in out])
    mean, var = plain_smoother(u, z, at, q, r, z.mean())
    assert np.allclose(np.log([x["price"] for x in out]), mean, atol=1e-6)
    assert np.allclose(spread, np.sqrt(var), rtol=1e-5)


def test_grid_marks_unusable_repeated_and_empty(spark):
    t = lambda s: datetime.fromtimestamp(s, timezone.utc)
    rows = [("a", t(100), 5.0, None, t(1)), ("a", t(100), 6.0, 2.0, t(2)), ("a", t(100), 6.0, 2.0, t(2)), ("a", t(111), None, 1.0, t(1)), ("a", t(121), float("nan"), 1.0, t(1)), ("a", t(131), -3.0, 1.0, t(1)), ("a", t(145), 7.0, 1.0, None), ("b", t(5), 0.0, None, t(1)), (None, t(5), 1.0, 1.0, t(1)), ("a", None, 1.0, 1.0, t(1)), ("nostep", t(9), 1.0, 1.0, t(1))]
    df = spark.createDataFrame(rows, "feed string, at timestamp, price double, volume double, seen timestamp")
    feeds = spark.createDataFrame([("a", 10), ("a", 10), ("b", 5), ("c", 5), ("nostep", 0), (None, 5)], "feed string, step int")
    out = {(r["feed"], r["slot_epoch"]): r for r in grid.regular_grid(df, feeds, "feed", "at", "price", "volume", "seen", "step").collect()}
    assert set(out) == {("a", 100), ("a", 110), ("a", 120), ("a", 130), ("a", 140), ("b", 5)}
    assert [out["a", s]["is_missing"] for s in (100, 110, 120, 130, 140)] == [False, True, True, True, False]
    assert out["a", 100]["readings"] == 3 and out["a", 100]["volume"] == 2.0 and 5 < out["a", 120]["price"] < 8
    assert out["b", 5]["price"] is None and out["b", 5]["is_missing"]
    assert grid.regular_grid(df.filter("feed = 'zz'"), feeds, "feed", "at", "price", "volume", "seen", "step").count() == 0
