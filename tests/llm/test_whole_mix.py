import random

import pytest

from tidebook.llm.mixing import mix

ARGS = "id", "source", "tokens", "source", "share", "repeats"


@pytest.mark.parametrize("empty", ["absent", "hollow", "barred"])
def test_a_source_that_can_give_nothing_leaves_the_others_their_mix(spark, empty):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b"]), rng.randrange(1, 50)) for i in range(4_000)] + [(5_000 + i, "hollow", None) for i in range(9)] + [(6_000, "barred", 40)]
    sizes = spark.createDataFrame(rows, "id long, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.45, 1), ("b", 0.15, 1), (empty, 0.4, 0 if empty == "barred" else 3)], "source string, share double, repeats int")
    m = mix(sizes, targets, *ARGS)
    report = {r["source"]: r for r in m.report.collect()}
    assert report["a"]["reached_share"] == pytest.approx(0.75, abs=0.01) and report["b"]["reached_share"] == pytest.approx(0.25, abs=0.01)
    assert report[empty]["reached_tokens"] == 0 and report[empty]["reached_share"] == 0 and not report[empty]["reachable"]
    held = sum(t for _, s, t in rows if s == "a")
    assert report["a"]["reached_tokens"] == pytest.approx(held, abs=100)
    assert sum(r["reached_tokens"] for r in report.values()) == pytest.approx(report["a"]["mix_tokens"], abs=200)
    assert {r["source"] for r in m.uses.select("source").distinct().collect()} == {"a", "b"}
    none = mix(sizes, targets.filter("repeats <> 1"), *ARGS)
    assert none.uses.count() == 0 and none.report.first()["mix_tokens"] == 0


def test_a_mix_as_large_as_the_corpus_tells_its_shortfall(spark):
    """a is scarce (20 tokens, used twice at most, of 60 wanted), ghost has nothing, b gives its own budget and no more."""
    sizes = spark.createDataFrame([(i, "a", 1) for i in range(20)] + [(100 + i, "b", 1) for i in range(180)], "doc int, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.6, 1), ("ghost", 0.1, 3)], "source string, share double, repeats int")
    out = mix(sizes, targets, "doc", "source", "tokens", "source", "share", "repeats", total="corpus")
    got = {r["source"]: r for r in out.report.collect()}
    assert {s: r["mix_tokens"] for s, r in got.items()} == {"a": 200, "b": 200, "ghost": 200}
    assert got["a"]["reached_tokens"] == 40 and got["ghost"]["reached_tokens"] == 0 and abs(got["b"]["reached_tokens"] - 120) <= 1
    assert abs(got["a"]["reached_share"] - 40 / 160) < 0.01 and {s for s, r in got.items() if not r["reachable"]} == {"a", "ghost"}
    assert {r["uses"] for r in out.uses.filter("source = 'a'").collect()} == {2}
