import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidebook.functions.wideint import digits, limbs, sign_of
from tidebook.operators.balances import last_rises
from tidebook.operators.changefeed import apply_changes, current_version, upsert_state
from tidebook.util import fresh_path

SCHEMA = "id bigint, part string, amount string, gone boolean, at timestamp, k string, s int"
START = datetime(2024, 1, 1)


def held(rows):
    """The message that holds for each key: latest time, then a delete, by plain Python."""
    best = {}
    for r in rows:
        rank = (r[4] or datetime(1, 1, 1), bool(r[3]))
        if (r[0], r[1]) not in best or rank > best[r[0], r[1]][0]:
            best[r[0], r[1]] = (rank, r)
    return {k: (r[2], bool(r[3])) for k, (_, r) in best.items()}


def got(df):
    return {(r["id"], r["part"]): (r["amount"], r["is_deleted"]) for r in df.collect()}


def messages(seed, n=400):
    rng, out = random.Random(seed), []
    for i in range(n):
        key = (1, "hot") if i % 3 == 0 else (rng.randrange(20), rng.choice(["a", "b", None]))
        out.append((*key, str(i), rng.choice([True, False, None]), START + timedelta(seconds=i), "x", 1))
    out += rng.choices(out, k=n // 4)
    rng.shuffle(out)
    return out


def test_any_order_and_repetition_gives_the_same_state(spark):
    rows = messages(1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(upsert_state(df, ["id", "part"], "at", F.col("gone"), ["amount", "k", "s"])) == held(rows)
    assert got(upsert_state(df.orderBy(F.desc("at")), ["id", "part"], "at", F.col("gone"), ["amount", "k", "s"])) == held(rows)


def test_calls_add_up_and_tombstones_keep_late_messages_out(spark):
    rows, root = messages(2), fresh_path(spark, "t")
    for cut in (rows[250:], rows[:100], rows[100:250], rows[:50]):
        out = apply_changes(spark.createDataFrame(cut, SCHEMA), ["id", "part"], "at", F.col("gone"), ["amount"], root)
    assert got(out) == held(rows)
    assert current_version(spark, root) and current_version(spark, fresh_path(spark, "none")) is None


def test_ties_nulls_and_empty_tables(spark):
    same = [(1, "a", "5", False, START, None, None), (1, "a", "7", True, START, None, None), (2, None, None, None, None, None, None), (None, None, "3", False, START, None, None)]
    out = got(upsert_state(spark.createDataFrame(same, SCHEMA), ["id", "part"], "at", F.col("gone"), ["amount"]))
    assert out == {(1, "a"): ("7", True), (2, None): (None, False), (None, None): ("3", False)}
    tied = [(1, "a", "5", False, START, None, None), (1, "a", "6", False, START, None, None)]
    answers = {str(got(upsert_state(spark.createDataFrame(t, SCHEMA), ["id", "part"], "at", F.col("gone"), ["amount"]))) for t in (tied, tied[::-1])}
    assert len(answers) == 1
    assert upsert_state(spark.createDataFrame([], SCHEMA), ["id", "part"], "at", F.col("gone"), ["amount"]).count() == 0


def test_limbs_are_exact(spark):
    texts = [" +007", "-12", "1" * 84, "-" + "9" * 80, None, "", "x", "-0", "1 000"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", digits(F.col("t")).alias("d"))
    assert [r["d"] for r in rows.collect()] == ["7", "12", "1" * 84, "9" * 80, None, None, None, "0", "1000"]
    numbers = [10**28, -(10**28) + 1, -1, 10**70, -(10**70) + 5, 3]
    for take in (2, 3, 4, 5, 6):
        df = spark.createDataFrame([(str(abs(n)), 1 if n > 0 else -1) for n in numbers[:take]], "d string, s int")
        sums = df.select(*[x.alias(f"m{i}") for i, x in enumerate(limbs(F.col("d"), F.col("s")))]).agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(3)])
        total = sum(numbers[:take])
        assert sums.select(sign_of([F.col(f"m{i}") for i in range(3)]).alias("s")).first()["s"] == (total > 0) - (total < 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_last_rises_against_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(20_000), i, rng.choice([1, -1]), rng.randrange(1, 4)) for i in range(500)]
    df = spark.createDataFrame(rows, "owner string, block bigint, n int, sign int, size int")
    moves = df.select("owner", "block", "n", (F.col("sign") > 0).alias("opens"), *[x.alias(f"m{i}") for i, x in enumerate(limbs(F.col("size").cast("string"), F.col("sign")))])
    out = {r["owner"]: r["n"] for r in last_rises(moves, ["owner"], ["block", "n"], ["m0", "m1", "m2"], "opens", ["n"]).collect()}
    want, level, opened = {}, {}, {}
    for owner, block, n, sign, size in sorted(rows, key=lambda r: (r[1], r[2])):
        before = level.get(owner, 0)
        level[owner] = before + sign * size
        if sign > 0 and before <= 0 < level[owner]:
            opened[owner] = n
    want = {o: opened[o] for o, v in level.items() if v > 0}
    assert out == want
