import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tidebook.operators.fees import attribute_collections
from tidebook.operators.matching import _walk, depth_mismatches, fifo_pairs, join_pairs, nearest_links, overlapping
from tidebook.operators.ordered import asof_join, interval_join, keep_last, order_key, running_sums


def walk(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.choice([1, 2, None]), i, rng.random() < 0.5) for i in range(n)]


@pytest.mark.parametrize(("seed", "width"), [(1, 4_096), (2, 7), (3, 1)])
def test_fifo_against_a_queue(spark, seed, width):
    rows = walk(seed)
    df = spark.createDataFrame(rows, "who string, size int, n int, opens boolean").orderBy(F.rand(seed))
    out = fifo_pairs(df, ["who", "size"], ["n"], "opens", "n", ["who"], width=width)
    queues, want, counts = {}, set(), {}
    for who, size, n, opens in rows:
        q = queues.setdefault((who, size), deque())
        if opens:
            q.append(n)
        elif q:
            counts[n] = len(q)
            want.add((q.popleft(), n))
    pairs = join_pairs(out, ["who", "size"], "opens", ["n"])
    assert {(r["entry_n"], r["exit_n"]) for r in pairs.collect()} == want
    assert {r["n"]: r["candidate_count"] for r in out.filter("is_matched AND NOT opens").collect()} == counts
    left = {r["n"]: r["unmatched_reason"] for r in out.filter("NOT is_matched").collect()}
    assert set(left) == {n for _, _, n, _ in rows} - {n for p in want for n in p}
    assert all(reason == ("no_subsequent_close" if rows[n][3] else "no_preceding_open") for n, reason in left.items())
    places = {}
    for who, _, n, _ in rows:
        places.setdefault(who, []).append(n)
    assert all(places[r["who"]][r["base_position"] - 1] == r["n"] for r in out.collect())


def test_a_hot_key_is_spread_over_stretches(spark):
    """A third of the rows under one key: no sorted group is larger than a stretch holds."""
    rows = [("hot" if i % 3 == 0 else f"k{i % 500}", i, (i // 3) % 2 == 0) for i in range(6_000)]
    df = spark.createDataFrame(rows, "who string, n int, opens boolean")
    out = fifo_pairs(df, ["who"], ["n"], "opens", "n", width=300)
    groups = _walk(df, ["who"], ["n"], "opens", 300).groupBy("__e", "__w").count()
    assert groups.agg(F.max("count")).first()[0] <= 300 / 3
    queue, want = deque(), set()
    for who, n, opens in rows:
        if who == "hot":
            if opens:
                queue.append(n)
            elif queue:
                want.add((queue.popleft(), n))
    pairs = join_pairs(out.filter("who = 'hot'"), ["who"], "opens", ["n"]).collect()
    assert {(r["entry_n"], r["exit_n"]) for r in pairs} == want


@pytest.mark.parametrize("width", [4_096, 9])
def test_links_against_a_stack(spark, width):
    rows = walk(3)
    stacks, want = {}, set()
    for who, size, n, opens in rows:
        s = stacks.setdefault((who, size), [])
        if opens:
            s.append(n)
        elif s:
            want.add((s.pop(), n))
    df = spark.createDataFrame(rows, "who string, size int, n int, opens boolean")
    assert {(r["open_n"], r["close_n"]) for r in nearest_links(df, ["who", "size"], ["n"], "opens", "n", width).collect()} == want


@pytest.mark.parametrize("width", [4_096, 5])
def test_overlaps_are_strict(spark, width):
    rng = random.Random(4)
    rows = [(i, rng.choice(["x", "y", None]), a := rng.randrange(100), a + rng.randrange(1, 6)) for i in range(60)] + [(100, "z", 1, 5), (101, "z", 5, 9)]
    df = spark.createDataFrame(rows, "i int, who string, a int, b int")
    want = {r[0] for r in rows for q in rows if r[0] != q[0] and r[1] is not None and r[1] == q[1] and r[2] < q[3] and q[2] < r[3]}
    assert {r["i"] for r in overlapping(df, ["who"], "a", "b", ["b", "i"], width).collect()} == want


def test_depth_mismatch(spark):
    df = spark.createDataFrame([(1, "a", True, 1), (2, "a", False, 1), (3, "b", True, 1), (4, "b", False, 2), (5, None, True, 3), (6, None, False, 4)], "n int, who string, opens boolean, depth int")
    assert {r["n"] for r in depth_mismatches(df, ["who"], "opens", "depth").collect()} == {3, 4, 5, 6}


@pytest.mark.parametrize("width", [10**6, 3])
def test_fees_split_interim_and_exit(spark, width):
    """Keys are block * 100 + transaction * 10 + log. The exit of a is 421, in transaction 420 to 429."""
    pairs = spark.createDataFrame([("a", 100, 421, 420, 429, 1000, 5), ("b", 100, 421, 420, 429, 1000, 5), ("c", 421, 423, 420, 429, 0, None), (None, 1, 9, 1, 9, 0, 0), ("d", 1, 50, 40, 59, 10, 10)], "who string, entry long, exit long, first long, last long, p0 long, p1 long")
    rows = [("a", 200, 10, 20), ("a", 300, 0, 1), ("a", 425, 1030, 6), ("a", 420, 99, 99), ("a", 430, 7, 7), ("a", 100, 5, 5), ("a", None, 1, 1), (None, 5, 1, 1), ("c", 425, 3, None), ("c", 422, 9, 9)]
    rows += [("d", 20, 1, 1), ("d", 55, 50, 9)]
    collects = spark.createDataFrame(rows, "who string, at long, x long, y long")
    out = {r["who"]: r for r in attribute_collections(pairs, ["who"], collects, ["who"], "entry", "exit", ("first", "last"), "at", ["x", "y"], ["p0", "p1"], width).collect()}
    told = lambda w: tuple(int(out[w][c]) for c in ("fee_x", "fee_y", "interim_count", "exit_count", "exit_covers_principal"))
    assert told("a") == (40, 22, 2, 1, True)
    assert told("b") == (0, 0, 0, 0, False) and told(None) == (0, 0, 0, 0, True)
    assert told("c") == (3, 0, 0, 1, True)
    assert told("d") == (1, 1, 1, 1, False) and (out["d"]["exit_x"], out["d"]["exit_y"]) == (50, 9)


@pytest.mark.parametrize(("strict", "tolerance"), [(True, None), (False, 30)])
def test_asof_against_a_scan(spark, strict, tolerance):
    rng = random.Random(5)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([rng.randrange(1000), None])) for i in range(200)]
    right = [(rng.choice(["a", "b", None]), rng.randrange(200, 900), rng.randrange(50), k) for k in range(150)]
    out = asof_join(spark.createDataFrame(left, "i int, s string, t int"), spark.createDataFrame(right, "s string, u int, v int, k int"), "t", "u", ["v"], 37, by=["s"], strict=strict, tolerance=tolerance, tie="k")
    got = {r["i"]: (r["v"], r["u_matched"]) for r in out.collect()}
    assert len(got) == len(left)
    for i, s, t in left:
        before = [(u, k, v) for rs, u, v, k in right if rs == s and s is not None and t is not None and (u < t or not strict and u == t)]
        best = max(before, default=None)
        ok = best and (tolerance is None or t - best[0] <= tolerance)
        assert got[i] == ((best[2], best[0]) if ok else (None, None))


def test_running_sums_interval_join_and_keys(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(500), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "t int, i int, x int")
    got = {r["i"]: r["total"] for r in running_sums(df, "t", ["i"], {"total": F.col("x")}, 40).collect()}
    assert got == {i: sum(x for u, j, x in rows if (u, j) <= (t, i)) for t, i, _ in rows}
    spans = [(k, a := rng.randrange(500), a + rng.randrange(0, 200)) for k in range(40)]
    hits = interval_join(spark.createDataFrame(spans, "k int, a int, b int"), df, "a", "b", "t", 30)
    assert sorted((r["k"], r["i"]) for r in hits.collect()) == sorted((k, i) for k, a, b in spans for t, i, _ in rows if a < t < b)
    last = keep_last(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z")], "k string, n int, v string"), ["k"], ["n"])
    assert {(r["k"], r["v"]) for r in last.collect()} == {("a", "y"), (None, "z")}
    keys = spark.createDataFrame([(1, 2, 9), (1, 3, 0), (2, 0, 0), (None, 1, 1)], "b long, t long, g long").select(order_key("b", "t", "g").alias("k"))
    values = [r["k"] for r in keys.collect()]
    assert values[:3] == sorted(values[:3]) and values[3] is None
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(1, 100_000, 0)], "b long, t long, g long").select(order_key("b", "t", "g")).collect()
