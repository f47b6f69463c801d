import random
from datetime import date, timedelta

import pytest

from tidebook.operators.intervals import periods_and_gaps, run_bitmaps
from tidebook.operators.rolling import rolling_totals


def test_rolling_against_plain_sums(spark):
    rng, day0 = random.Random(1), date(2024, 1, 1)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", None]), day0 + timedelta(days=rng.randrange(90)), rng.choice([rng.random() * 10, None, float("nan"), float("inf"), -2.5]), 1, "x") for i in range(300)]
    rows += [("one", day0, 4.0, 1, "x"), ("b", None, 3.0, 1, "x")]
    df = spark.createDataFrame(rows, "pool string, day date, x double, e0 int, d string")
    out = rolling_totals(df, ["pool"], "day", ["x"], [7, 30]).collect()
    ok = lambda v: v is not None and v == v and abs(v) != float("inf")
    want_rows = 0
    for pool in {r[0] for r in rows} - {"b"}:
        days = [r[1] for r in rows if r[0] == pool]
        want_rows += (max(days) - min(days)).days + 1
    assert len(out) == want_rows
    for r in out:
        for w in (7, 30):
            inside = [(x[1], x[2]) for x in rows if x[0] == r["pool"] and r["as_of"] - timedelta(days=w) < x[1] <= r["as_of"]] if r["pool"] != "b" else []
            total = sum(round(v, 9) for _, v in inside if ok(v))
            assert r[f"x_total_{w}d"] == pytest.approx(total, abs=1e-6)
            assert r[f"x_mean_{w}d"] == pytest.approx(total / w, abs=1e-6)
            assert r[f"x_known_{w}d"] == len({d for d, v in inside if ok(v)})


def test_rolling_empty(spark):
    assert rolling_totals(spark.createDataFrame([], "p string, d date, x double"), ["p"], "d", ["x"], [7]).count() == 0


def plain_spans(rows):
    out, by = set(), {}
    for *key, a, b in rows:
        if a is not None and b is not None and a < b:
            by.setdefault(tuple(key), []).append((a, b))
    for key, spans in by.items():
        end = None
        for a, b in sorted(spans):
            if end is None or a > end:
                if end is not None:
                    out |= {(*key, "period", start, end), (*key, "gap", end, a)}
                start, end = a, b
            end = max(end, b)
        out.add((*key, "period", start, end))
    return out


@pytest.mark.parametrize("width", [50, 70_000, 10**7, 10**12, 2**59])
def test_spans_against_plain_merging(spark, width):
    rng = random.Random(width)
    rows = []
    for i in range(300):
        a = rng.randrange(-width, width)
        rows.append(("hot" if i % 3 == 0 else rng.choice(["a", None]), rng.choice([1, None]), a, rng.choice([a, a + 1, a - 3, None, a + rng.randrange(1, max(2, width // 20))])))
    rows += rows[:40]
    df = spark.createDataFrame(rows, "owner string, tick int, a bigint, b bigint").repartition(5)
    out = [tuple(r) for r in periods_and_gaps(df, ["owner", "tick"], "a", "b").collect()]
    assert len(out) == len(set(out))
    assert set(out) == plain_spans(rows)


def test_long_intervals_cost_few_pieces_and_touching_ones_join(spark):
    rows = [("x", 0, 10**15), ("x", 10**15, 10**15 + 5), ("y", 5, 65_536), ("y", 65_536, 65_537), ("z", None, 3), ("z", 3, 3)]
    df = spark.createDataFrame(rows, "e string, a bigint, b bigint")
    assert run_bitmaps(df, ["e"], "a", "b").count() <= 14
    assert {tuple(r) for r in periods_and_gaps(df, ["e"], "a", "b").collect()} == {("x", "period", 0, 10**15 + 5), ("y", "period", 5, 65_537)}
    assert periods_and_gaps(df.filter("e = 'none'"), ["e"], "a", "b").count() == 0
