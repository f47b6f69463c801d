import json
from datetime import date, datetime
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidebook import cli
from tidebook.functions import abi, formulas
from tidebook.functions.exact import ratio_text
from tidebook.operators.densify import coverage_faults, dense_days, dense_grid, gap_runs
from tidebook.operators.quality import QualityError, count_violations, repeated_keys, require, require_columns
from tidebook.operators.statistics import spearman
from tidebook.sources import config, manifest
from tidebook.sources.files import write_once


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_formulas_keep_their_laws(spark):
    low, high, liquidity = F.lit(100.0), F.lit(400.0), F.lit(10.0)
    inv = lambda p: [one(spark, c) for c in formulas.inventory(F.lit(p), low, high, liquidity)]
    assert inv(25.0)[1] == 0 and all(v > 0 for v in inv(225.0)) and abs(inv(900.0)[0]) < 1e-12
    cost = lambda a, b: one(spark, formulas.convexity_cost(F.lit(a), F.lit(b), low, high, liquidity))
    assert cost(196.0, 225.0) == pytest.approx(10 * (15 - 14) ** 2 / 14)
    assert cost(25.0, 81.0) == cost(500.0, 900.0) == cost(200.0, 200.0) == 0 and cost(81.0, 121.0) > 0
    assert cost(200.0, 250.0) + cost(250.0, 200.0) > 0
    assert one(spark, formulas.convexity_cost(F.lit(None).cast("double"), F.lit(1.0), low, high, liquidity)) is None
    assert one(spark, formulas.rebalancing_step(F.lit(200.0), F.lit(200.0), F.lit(3.0), low, high, liquidity)) == 0
    assert one(spark, F.exp(2 * formulas.daily_log_rate(F.lit(5.0)))) == pytest.approx((1 + 0.05 / 360) ** 2)
    price = one(spark, formulas.tick_price(F.lit(-200_000)))
    assert one(spark, formulas.sqrt_price(F.lit(str(int((price / 1e12) ** 0.5 * 2**96))))) == pytest.approx(price, rel=1e-9)
    with pytest.raises(Exception, match="above 0"):
        one(spark, formulas.human_liquidity(F.lit("0")))


def test_words_of_any_width(spark):
    numbers = [0, 1, -1, 10**18, -(10**30), 2**127, 2**255 - 1, -(2**255), -100]
    df = spark.createDataFrame([(f"{n % 2**256:064x}", str(n)) for n in numbers], "w string, want string")
    assert [r["x"] for r in df.select(abi.integer_word(F.col("w"), True).alias("x")).collect()] == [str(n) for n in numbers]
    assert [r["x"] for r in df.select(abi.integer_word(F.col("w")).alias("x")).collect()] == [str(n % 2**256) for n in numbers]
    assert one(spark, abi.small_signed(F.lit(f"{-887272 % 2**256:064x}"))) == -887_272
    data = "0x" + "0" * 63 + "7" + "AB" * 32
    assert one(spark, abi.words(F.lit(data))) == ["0" * 63 + "7", "ab" * 32] and one(spark, abi.words(F.lit(None).cast("string"))) == []
    topics = json.dumps(["0xaa", "0x" + "0" * 24 + "3" * 40])
    assert one(spark, abi.address_word(abi.topic_word(F.lit(topics), F.lit(1)))) == "0x" + "3" * 40
    for broken in (abi.words(F.lit("0x123")), abi.hex_data(F.lit("zz")), abi.topic_word(F.lit(topics), F.lit(5)), abi.integer_text(F.lit("1.5"))):
        with pytest.raises(Exception):
            one(spark, broken)
    assert [one(spark, abi.integer_text(F.lit(t))) for t in ("007", "-0", "+5", "-0012")] == ["7", "0", "5", "-12"]
    assert one(spark, abi.optional_text(F.lit("<NA>"))) is None


def test_exact_ratio(spark):
    assert one(spark, ratio_text(F.lit("1"), F.lit("3"))) == "0." + "3" * 60
    assert one(spark, ratio_text(F.lit("1"), F.lit("0"))) is None


def test_densify(spark):
    ticks = spark.createDataFrame([(0, 10.0, 1), (1, 11.0, 2), (125, 12.0, 3)], "at long, price double, volume int")
    rows = sorted(dense_grid(ticks, "at", "price", "volume", 2, 7).collect())
    assert [r["at"] for r in rows] == list(range(0, 125, 2)) and rows[0]["price"] == 11.0 and rows[0]["volume"] == 3
    assert rows[30]["price"] == 11.0 and rows[30]["volume"] == 0 and rows[30]["is_imputed"] and rows[-1]["price"] == 12.0
    gaps = gap_runs(spark.createDataFrame([(2,), (4,), (10,)], "at long"), "at", 2).collect()
    assert {(r["gap_start"], r["gap_end"], r["points"]) for r in gaps} == {(2, 4, 2), (10, 10, 1)}
    days = spark.createDataFrame([(date(2024, 1, 1), 1.0), (date(2024, 1, 4), 2.0)], "day date, v double")
    plain = dense_days(days, "day", ["v"], start=F.lit(date(2024, 1, 2)))
    led = dense_days(days, "day", ["v"], lead_in=True, start=F.lit(date(2024, 1, 2)))
    assert [r["v"] for r in sorted(plain.collect())] == [None, None, 2.0] and [r["v"] for r in sorted(led.collect())] == [1.0, 1.0, 2.0]
    parts = spark.createDataFrame([(1, 0, 5), (2, 5, 9), (3, 20, 30), (4, 31, 30)], "n int, a int, b int")
    assert {(r["n"], r["fault"]) for r in coverage_faults(parts, "n", "a", "b", 1).collect()} == {(2, "overlap"), (3, "hole"), (4, "reversed")}


def test_quality(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (3, 1)], "a int, b int")
    counts = {r["rule"]: r["violations"] for r in count_violations(df, {"ordered": F.col("a") < F.col("b"), "positive": F.col("a") > 0}).collect()}
    assert counts == {"ordered": 2, "positive": 0}
    with pytest.raises(QualityError, match="twice: 1"):
        require(repeated_keys(df, ["a"], "twice"))
    with pytest.raises(QualityError):
        require_columns(df, {"a": "string"})
    assert spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, 9.0), (None, 1.0)], "x double, y double"), "x", "y").first()["rho"] == pytest.approx(1)


def test_write_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert write_once(spark.range(5), path) is True and write_once(spark.range(5), path) is False
    with pytest.raises(FileExistsError):
        write_once(spark.range(6), path)


def test_manifests_and_cli(tmp_path, capsys):
    root, target = tmp_path / "data", tmp_path / "copy"
    assert cli.main(["--data-root", str(root), "init"]) == 0
    file = root / "raw" / "a.parquet"
    pq.write_table(pa.table({"x": [1, 2, 3]}), file)
    assert cli.main(["--data-root", str(root), "register", "events", str(file)]) == 0
    m = manifest.load(root / "manifest.json")
    assert m["totals"]["rows"] == 3 and cli.main(["--data-root", str(root), "verify"]) == 0
    assert manifest.copy_dataset(root, target, m) == {"copied": 1, "skipped": 0} and manifest.copy_dataset(root, target, m) == {"copied": 0, "skipped": 1}
    (target / "raw" / "a.parquet").write_bytes(b"other")
    with pytest.raises(manifest.ManifestError):
        manifest.copy_dataset(root, target, m)
    (root / "raw" / "b.partial").touch()
    assert cli.main(["--data-root", str(root), "status"]) == 1
    for path in ("../x", "/x", ""):
        with pytest.raises(manifest.ManifestError):
            manifest.inside(Path("r"), path)
    capsys.readouterr()


def test_config():
    c = config.Collection("0x" + "Ab" * 20, 18, 6, 12_000_000, 24_000_001)
    assert c.run_id == "abababab_b12000000_b24000001"
    with pytest.raises(ValueError):
        config.Collection("0x12", 18, 6, 1, 2)
    with pytest.raises(ValueError):
        config.Collection("0x" + "ab" * 20, 18, 6, 2, 2)
    assert datetime.now() and config.data_root("/tmp").name == "tmp"
