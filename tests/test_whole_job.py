import math
import random
from datetime import datetime, timedelta, timezone
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from tidebook.operators import pathmetrics
from tidebook.operators.densify import gap_runs
from tidebook.operators.ordered import exact_prior, interval_extremes
from tidebook.plans import matching, risk, statistics, timeseries

DAY0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def events(spark, folder, rows, first=0):
    """An events table from (seconds after the first day's start, user, kind, value, k), numbered from ``first`` on."""
    cells = [(i, DAY0 + timedelta(seconds=s), user, kind, float(value), f'{{"k": {k}}}') for i, (s, user, kind, value, k) in enumerate(rows, first)]
    spark.createDataFrame(cells, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.mode("overwrite").parquet(f"{folder}/events.parquet")
    return str(folder)


def test_rolling_windows_hold_thirty_rows_and_days(spark, tmp_path):
    rng, days = random.Random(1), [n for n in range(70) if n not in range(40, 50)]
    close = {n: round(30 + rng.random() * 20, 2) for n in days}
    rows = [(n * 86_400 + 3_600, 1, "click", close[n], 1) for n in days] + [(66 * 86_400, 2, "signup", 1, 1), (68 * 86_400, 2, "purchase", 1, 1), (5 * 86_400, 3, "signup", 1, 1), (6 * 86_400, 3, "purchase", 1, 1)]
    d = events(spark, tmp_path, rows)
    name = lambda n: (DAY0 + timedelta(days=n)).strftime("%Y-%m-%d")
    near = lambda v: None if v is None else pytest.approx(v, abs=1e-7)
    got = {r["day"]: r for r in timeseries.rolling_means(spark, d).collect()}
    returns = {n: math.log(close[n] / close[m]) for m, n in zip(days, days[1:])}
    historic, sigma = {r["day"]: r["historic"] for r in timeseries.volatility(spark, d).collect()}, {}
    for i, n in enumerate(days):
        last, recent = [close[m] for m in days[max(0, i - 29) : i + 1]], [close[m] for m in days if n - 30 < m <= n]
        assert got[name(n)]["mean_rows"] == near(mean(last))
        assert got[name(n)]["mean_days"] == near(mean(recent) if len(recent) >= 7 else None)
        assert got[name(n)]["std_rows"] == near(stdev(last) if len(last) == 30 else None)
        sigma[n] = stdev([returns[m] for m in days[i - 29 : i + 1]]) if i >= 30 else None
        assert historic[name(n)] == near(sigma[n] * math.sqrt(365) if i >= 30 else None)
    # the entry on day 66 knows the closes up to day 65; the one on day 5 has no 30 returns before it
    out = sorted(risk.expected_loss(spark, d).collect(), key=lambda r: r["applicable"])
    price, low, high = close[65], 20.0, 120.0
    assert [r["applicable"] for r in out] == [False, True] and out[0]["expected"] is None
    width = 2 * (1 - math.sqrt(low / price)) + 2 * (1 - math.sqrt(price / high))
    assert out[1]["expected"] == pytest.approx((math.exp(-(sigma[65] ** 2) * 2 / 8) - 1) / width, abs=1e-6)


def test_gap_runs_cross_hours_and_stretches(spark, tmp_path):
    trades = [59, 61, 130, 119, 120, 900, 901, 902]
    d = events(spark, tmp_path, [(60 * m, 1, "click", 1, 1) for m in trades])
    start = int(DAY0.timestamp()) // 60
    got = {(r["gap_start"] // 60 - start, r["gap_end"] // 60 - start, r["points"]) for r in timeseries.minute_gaps(spark, d).collect()}
    at = sorted(trades)
    assert got == {(a + 1, b - 1, b - a - 1) for a, b in zip(at, at[1:]) if b - a > 1}
    rng = random.Random(2)
    points = [(s, 3 * n) for s in ("a", None) for n in range(-300, 300) if rng.random() < 0.9]
    want = set()
    for s, x in points:
        if (s, x - 3) not in (held := set(points)):
            last = x
            while (s, last + 3) in held:
                last += 3
            want.add((s, x, last, (last - x) // 3 + 1))
    df = spark.createDataFrame(points, "s string, x long")
    for width in (2, 7, 30, 5_000):
        runs = gap_runs(df, "x", 3, ["s"], width).collect()
        assert len(runs) == len(want) and {(r["s"], r["gap_start"], r["gap_end"], r["points"]) for r in runs} == want


@pytest.mark.parametrize(("first", "users"), [(99_950, 40), (2**40, 2**40), (0, 40)])
def test_event_order_has_no_bound_on_ids(spark, tmp_path, first, users):
    rng = random.Random(3)
    rows = [(rng.randrange(120), users - 20 * rng.randrange(2), rng.choice(["signup", "purchase", "click", "error"]), rng.randrange(1, 90), 1) for _ in range(100)]
    d = events(spark, tmp_path, rows, first)
    want = sorted(range(100), key=lambda i: (rows[i][0] // 12, rows[i][1], i))
    got = matching.ledger_events(spark, d).collect()
    assert [r["log_index"] - first for r in got] == want and len({r["order_key"] for r in got}) == 100
    price, state = 50.0, {}
    for i in want:
        if rows[i][2] == "click":
            price = float(rows[i][3])
        else:
            state[i] = price
    assert {r["log_index"] - first: r["price"] for r in timeseries.state_before(spark, d).collect()} == state
    queue, pairs = [], set()
    for i in want:
        if rows[i][2] == "signup":
            queue.append(i)
        elif rows[i][2] == "purchase" and queue:
            pairs.add((queue.pop(0), i))
    assert {(r["entry_log_index"] - first, r["exit_log_index"] - first) for r in matching.fifo_position_pairs(spark, d).collect()} == pairs


@pytest.mark.parametrize("strict", [True, False])
def test_range_sums_of_any_number_of_ranges(spark, strict):
    """2,100 positions of nearly as many ranges and liquidities, against every move of every life."""
    rng = random.Random(4)
    prices = [rng.uniform(10, 90) for _ in range(70)]
    moves = [(3 * i, prices[i - 1] if i else None, prices[i], rng.uniform(10, 90)) for i in range(70)] + [(None, 20.0, 30.0, 25.0), (60, None, None, None)]
    tick = lambda n: 1.0001**n
    positions = [(i, tick(rng.randrange(24_000, 35_000)), tick(rng.randrange(36_000, 45_000)), 1 + i / 7, a := rng.randrange(190), a + rng.randrange(0, 60)) for i in range(2_100)]
    positions += [(2_100, 10.0, None, 1.0, 0, 90), (2_101, 10.0, 60.0, None, 0, 90), (2_102, 10.0, 60.0, 1.0, None, 90), (2_103, 10.0, 60.0, 1.0, 300, 400), (2_104, prices[3], prices[5], 1.0, 0, 200)]
    df = spark.createDataFrame(positions, "i int, low double, high double, e double, a long, b long")
    points, measures = pathmetrics.inventory_points({"rebalancing": (F.col("outside"), F.lit(1.0)), "convexity": (F.col("price"), F.exp(-F.col("t") / 100))})
    points = F.transform(points, lambda p: p.withField("n", F.when(p["rebalancing_y"] < 0, 1.0).otherwise(0.0)))
    path = spark.createDataFrame(moves, "t long, before double, price double, outside double")
    out = pathmetrics.range_sums(df, ["i"], path, "t", points, [*measures, "n"], "a", "b", 25, strict=strict)
    out = out.select("*", *[pathmetrics.inventory_cost(c).alias(c) for c in ("rebalancing", "convexity")]).collect()
    assert len(out) == len(positions)
    clip = lambda p, r: min(max(p, r["low"]), r["high"])
    for r in out:
        if r["high"] is None or r["a"] is None:
            assert r["rebalancing"] == 0 and r["n_high"] == 0
            continue
        mine = [m for m in moves if m[0] is not None and r["a"] < m[0] < r["b"] + (not strict)]
        assert r["moves"] == len(mine)
        cost = {"rebalancing": 0.0, "convexity": 0.0}
        for t, before, price, outside in mine:
            if before is None:
                continue
            x, y = 1 / math.sqrt(clip(price, r)) - 1 / math.sqrt(clip(before, r)), math.sqrt(clip(price, r)) - math.sqrt(clip(before, r))
            cost["rebalancing"] -= outside * x + y
            cost["convexity"] -= math.exp(-t / 100) * (price * x + y)
        assert all(r[c] == pytest.approx(v, abs=1e-9) for c, v in cost.items())
        assert r["n_high"] - r["n_low"] == sum(m[1] is not None and r["low"] <= m[1] < r["high"] for m in mine)


def test_range_sums_without_moves_or_positions(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 0, 9)], "i int, low double, high double, a long, b long")
    path = spark.createDataFrame([], "t long, before double, price double, outside double")
    points, measures = pathmetrics.inventory_points({"x": (F.col("outside"), F.lit(1.0))})
    assert [r["x_xr_low"] for r in pathmetrics.range_sums(df, ["i"], path, "t", points, measures, "a", "b", 10).collect()] == [0]
    some = spark.createDataFrame([(5, 12.0, 14.0, 13.0)], path.schema)
    assert pathmetrics.range_sums(df.limit(0), ["i"], some, "t", points, measures, "a", "b", 10).count() == 0


def test_exact_prior_wants_whole_times_and_points(spark):
    grid = spark.createDataFrame([(9, 1.0), (10, 2.0), (11, 3.0)], "sec long, price double")
    probes = lambda *t: spark.createDataFrame([(x,) for x in t], "at double")
    assert [r["price"] for r in exact_prior(probes(10.0, 12.0, None), grid, "at", "sec", ["price"]).orderBy("at").collect()] == [None, 1.0, 3.0]
    assert [r["price"] for r in exact_prior(probes(30.0), grid, "at", "sec", ["price"], required=False).collect()] == [None]
    for wrong in (10.5, 9.0):
        with pytest.raises(Exception, match="time is not whole|no grid point"):
            exact_prior(probes(wrong), grid, "at", "sec", ["price"]).collect()


def test_regressions_keep_every_finite_row(spark, tmp_path):
    rng, nan = random.Random(5), float("nan")
    rows = [(DAY0, rng.uniform(-0.9, 0.9) * (100 if i % 10 == 0 else 1), *[rng.gauss(0, 1) * (50 if i % 7 == 0 else 1) for _ in range(3)]) for i in range(200)]
    rows += [(DAY0, nan, 1.0, 1.0, 1.0), (DAY0, 1.0, float("inf"), nan, None), (DAY0, None, 1.0, 1.0, 1.0), (DAY0, 315.0, 20.0, -30.0, 0.1)]
    names = ("il_loss_on_initial", "lvr_rebalancing_on_initial", "pl_loss_on_initial")
    columns = ", ".join(f"{n} double" for n in ("lp_total_return_realized_fee", *names))
    spark.createDataFrame(rows, f"exit_timestamp timestamp, {columns}").write.parquet(f"{tmp_path}/position_metrics.parquet")
    got, r2 = {r["metric"]: r for r in statistics.ols_tracking(spark, str(tmp_path)).collect()}, {}
    for i, name in enumerate(names):
        kept = [(r[2 + i], r[1]) for r in rows if r[1] is not None and r[2 + i] is not None and math.isfinite(r[1]) and math.isfinite(r[2 + i])]
        mx, my = mean(x for x, _ in kept), mean(y for _, y in kept)
        slope = sum((x - mx) * (y - my) for x, y in kept) / sum((x - mx) ** 2 for x, _ in kept)
        rest = sum((y - my - slope * (x - mx)) ** 2 for x, y in kept)
        r2[name] = 1 - rest / sum((y - my) ** 2 for _, y in kept)
        assert got[name]["n"] == len(kept) and got[name]["slope"] == pytest.approx(slope, abs=1e-6) and got[name]["intercept"] == pytest.approx(my - slope * mx, abs=1e-6)
        assert got[name]["r_squared"] == pytest.approx(r2[name], abs=1e-6) and got[name]["rmse"] == pytest.approx(math.sqrt(rest / len(kept)), abs=1e-6)
    assert [r["metric"] for r in statistics.best_tracker(spark, str(tmp_path)).collect()] == [max(names, key=r2.get)]


def test_formula_grid_keeps_trades_of_no_cents(spark, tmp_path):
    values = [0.0, 30.5, 0.004, 0.0, 0.01]
    d = events(spark, tmp_path, [(60 * i, 1, "click", v, 1) for i, v in enumerate(values)])
    got = risk.formula_grid(spark, d).orderBy("order_key").collect()
    assert [r["liquidity"] for r in got] == [0.0, 30.5, 0.0, 0.0, 0.01]
    assert [r["sqrt_price"] for r in got] == [0.01, 30.5, 0.01, 0.01, 0.01]


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_extremes_of_intervals_against_a_scan(spark, fan):
    rng = random.Random(fan)
    points = [(rng.randrange(300), float(rng.randrange(50))) for _ in range(200)] + [(None, 99.0)]
    ranges = [(5.0, 20.0), (10.0, 45.0), (60.0, 70.0)]
    intervals = [(i, a := rng.randrange(-5, 310), a + rng.choice([0, 1, 2, 40, 310]), *rng.choice(ranges)) for i in range(150)] + [(150, None, 5, *ranges[0])]
    want = {}
    for i, a, z, low, high in intervals:
        if a is not None and (held := [v for k, v in points if k is not None and a < k < z]):
            want[i] = (len(held), max(held), min(held), sum(low <= v <= high for v in held))
    df = spark.createDataFrame(intervals, "i long, a long, z long, low double, high double")
    out = interval_extremes(df, ["i"], spark.createDataFrame(points, "k long, v double"), "a", "z", "k", "v", "low", "high", 25, fan).collect()
    assert len(out) == len(want) and {r["i"]: tuple(r)[1:] for r in out} == want


def test_extremes_without_points(spark):
    df = spark.createDataFrame([(1, 0, 9, 1.0, 2.0)], "i long, a long, z long, low double, high double")
    assert interval_extremes(df, ["i"], spark.createDataFrame([], "k long, v double"), "a", "z", "k", "v", "low", "high", 25).count() == 0
