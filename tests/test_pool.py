import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidebook.functions import abi, events, times
from tidebook.operators.returns import closed_returns, pair_returns
from tidebook.plans import pool
from tidebook.sources import manifest

POOL, MANAGER = "0x" + "Aa" * 20, "0x" + "bb" * 20
BASE = "block_number long, block_timestamp timestamp, transaction_hash string, transaction_index int, log_index int, address string, topics_json string, data string, removed boolean"


def word(value):
    return value[2:].rjust(64, "0") if isinstance(value, str) else f"{value % 2**256:064x}"


def log(layout, values, address, **other):
    cells = dict(zip(layout.places, values))
    topics = other.get("topics", [layout.topic.upper().replace("0X", "0x"), *["0x" + word(cells[p]) for p in sorted(cells) if p[0] == "t"]])
    data = other.get("data", "0x" + "".join(word(cells[p]) for p in sorted(cells) if p[0] == "w"))
    return (5, None, "0xAB", 1, 2, address, json.dumps(topics) if topics is not None else None, data, other.get("removed"))


def values_of(layout, rng):
    edge = {"uint256": [0, 2**256 - 1, 10**30], "int256": [-(2**255), 2**255 - 1, -1], "uint128": [0, 2**128 - 1], "uint160": [2**160 - 1], "int24": [-887272, 887272, 0]}
    return [f"0x{rng.getrandbits(160):040x}" if t == "address" else rng.choice(edge[t]) for t in layout.types]


def test_hashes_of_known_signatures():
    topics = {x.signature: x.topic for x in events.LAYOUTS}
    assert topics["Transfer(address,address,uint256)"] == "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert events.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert len(set(topics.values())) == 9 and len(events.keccak256(b"x" * 300)) == 32


def test_logs_of_all_kinds_are_decoded_and_routed(spark):
    rng = random.Random(1)
    rows, want = [], []
    for x in events.LAYOUTS:
        for _ in range(4):
            v = values_of(x, rng)
            rows.append(log(x, v, POOL.lower() if x.frame == "pool" else " " + MANAGER.upper().replace("0X", "0x")))
            want.append((x.frame, x.kind, {c: -n if c == x.negated else n for c, n in zip(x.columns, v)}))
    out = events.decode_logs(spark.createDataFrame(rows, BASE), [POOL], [MANAGER]).collect()
    told = lambda r: (r["frame"], r["event_type"], {c: v for c, v in ((c, r[c]) for c in (*events.ADDRESSES, *events.TICKS, *events.INTEGERS)) if v is not None})
    as_text = lambda w: (w[0], w[1], {c: str(v) if c in events.INTEGERS else v for c, v in w[2].items()})
    assert sorted(map(str, (sorted(t[2].items()) for t in map(told, out)))) == sorted(map(str, (sorted(t[2].items()) for t in map(as_text, want))))
    assert {(r["frame"], r["event_type"]) for r in out} == {(x.frame, x.kind) for x in events.LAYOUTS}
    assert {r["transaction_hash"] for r in out} == {"0xab"} and {r["address"] for r in out} == {POOL.lower(), MANAGER}


def test_broken_logs_are_told_and_rejected(spark):
    rng = random.Random(2)
    mint, transfer = events.LAYOUTS[1], events.LAYOUTS[8]
    v, t = values_of(mint, rng), values_of(transfer, rng)
    broken = {"removed": log(mint, v, POOL, removed=True), "no topics": log(mint, v, POOL, topics=[]), "unknown topic": log(mint, v, POOL, topics=["0x" + "1" * 64]), "unknown contract": log(mint, v, "0x" + "3" * 40), "wrong contract": log(transfer, t, POOL)}
    rows = spark.createDataFrame([*broken.values(), log(mint, v, POOL), (5, None, "0xAB", 1, 2, POOL, None, "0x", None)], BASE)
    assert sorted(r["reason"] for r in events.rejected(rows, [POOL], [MANAGER]).collect()) == sorted([*broken, "no topics"])
    short = [log(mint, v, POOL, data="0x" + "0" * 64), log(mint, v, POOL, topics=[mint.topic]), log(mint, v, POOL, data="0x123")]
    for row in [*broken.values(), *short]:
        with pytest.raises(Exception, match="cannot be decoded|missing|whole words"):
            events.decode_logs(spark.createDataFrame([row], BASE), [POOL], [MANAGER]).collect()


def test_json_arguments_are_checked(spark):
    burn = next(x for x in events.LAYOUTS if x.kind == "Burn")
    who = "0x" + "C" * 40
    row = lambda args, signature=burn.signature: (5, "0xAB", " " + POOL, signature, args)
    read = lambda *r: events.events_from_arguments(spark.createDataFrame([*r], "block_number long, transaction_hash string, address string, event_signature string, args_json string")).collect()
    good = read(row(f'["{who}", -100, "0100", 340282366920938463463374607431768211455, "007", 0]'))[0]
    assert (good["owner"], good["tick_lower"], good["tick_upper"], good["liquidity_delta_raw"], good["amount0_raw"]) == (who.lower(), -100, 100, "-340282366920938463463374607431768211455", "7")
    for bad in (row(f'["{who}", -100, 100, 1, 2]'), row(f'["{who}", -100, null, 1, 2, 3]'), row(f'["{who}", -100, 1.5, 1, 2, 3]'), row(f'["{who}", -100, true, 1, 2, 3]'), row('["0x12", -100, 1, 1, 2, 3]'), row("[]", "Nothing()"), row("not json")):
        with pytest.raises(Exception, match="argument|integer|signature|address"):
            read(bad)


def test_integers_survive_encoding(spark):
    numbers = [0, 1, -1, 2**64 - 1, 2**64, -(2**64), 10**36, -(10**36), None]
    df = spark.createDataFrame([(None if n is None else str(n),) for n in numbers], "t string")
    got = df.select("t", abi.encoded_integer(F.col("t")).alias("w")).select("t", "w", abi.integer_word(F.col("w"), True).alias("back")).collect()
    assert all(r["back"] == r["t"] for r in got) and all(r["w"] == f"{int(r['t']) % 2**256:064x}" for r in got if r["t"])
    tidy = df.select(abi.integer_or_zero(F.col("t")).alias("z"), abi.magnitude_text(F.col("t")).alias("m")).collect()
    assert [r["z"] for r in tidy] == [str(n or 0) for n in numbers] and [r["m"] for r in tidy] == [str(abs(n or 0)) for n in numbers]


def test_returns_of_a_known_position(spark):
    """Deposit 1 and 2000 at 2000, principal 0.9 and 2100 and fees 0.03 and 30 at 2500."""
    columns = "i int, d0 string, d1 string, w0 string, w1 string, f0 string, f1 string, e double, x double, s double, ok boolean"
    base = ("1000000000000000000", "2000000000", "900000000000000000", "2100000000", "30000000000000000", "30000000", 2000.0, 2500.0)
    rows = [(1, *base, 86_400.0 * 30, True), (2, *base, 86_400.0, False), (3, *base[:6], None, 2500.0, 86_400.0, True), (4, "0", "0", *base[2:], 86_400.0, True), (5, *base, 0.0, True), (6, *base, None, None)]
    df = spark.createDataFrame(rows, columns)
    prices = {"entry": (F.col("e"), F.lit(1.0)), "exit": (F.col("x"), F.lit(1.0))}
    args = (("d0", "d1"), ("w0", "w1"), ("f0", "f1"), prices)
    closed = {r["i"]: r for r in closed_returns(df, *args).collect()}
    one = closed[1]
    assert [one[c] for c in ("initial_wealth_usdt", "principal_exit_value_usdt", "fee_exit_value_usdt", "lp_exit_value_usdt", "hodl_exit_value_usdt")] == pytest.approx([4000, 4350, 105, 4455, 4500])
    assert one["lp_total_return_close_marked"] == pytest.approx(0.11375) and one["lp_excess_return_vs_hodl_close"] == pytest.approx(-0.01) and one["il_return_vs_hodl_fee_exclusive"] == pytest.approx(-150 / 4500)
    assert closed[3]["lp_total_return_close_marked"] is None and closed[4]["fee_return_on_initial_wealth"] is None
    pairs = {r["i"]: r for r in pair_returns(df, *args, "s", F.col("ok")).collect()}
    assert pairs[1]["realized_daily_return_simple"] == pytest.approx(0.11375 / 30) and pairs[1]["holding_days"] == 30
    assert pairs[2]["initial_wealth_usdt"] is None and pairs[2]["holding_days"] == 1 and pairs[4]["lp_total_return_realized_fee"] is None
    assert pairs[5]["lp_total_return_realized_fee"] == pytest.approx(0.11375) and pairs[5]["realized_daily_log_return"] is None and pairs[6]["holding_days"] is None


def test_times_need_a_zone(spark):
    good = ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05.5+01:00", "2024-01-02T03:04:05-0230", None]
    df = spark.createDataFrame([(t,) for t in good], "t string")
    assert [r["x"] for r in df.select(times.iso_utc(times.utc_timestamp(F.col("t"))).alias("x")).collect()] == ["2024-01-02T03:04:05Z", "2024-01-02T02:04:05.500000Z", "2024-01-02T05:34:05Z", None]
    for bad in ("2024-01-02T03:04:05", "2024-01-02", "soon", ""):
        with pytest.raises(Exception, match="without a zone|not a time"):
            spark.createDataFrame([(bad,)], "t string").select(times.utc_timestamp(F.col("t"))).collect()


def test_manifest_counts_rows_and_keeps_data_sets_apart(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for folder, name in ((a, "one"), (b, "two")):
        folder.mkdir()
        pq.write_table(pa.table({"x": [1, 2, 3]}), folder / "x.parquet")
        made = manifest.register({"dataset_id": name}, folder, "rows", [folder / "x.parquet"])
        (folder / "manifest.json").write_text(json.dumps(made))
    held = manifest.load(a / "manifest.json")
    assert manifest.faults(a, held) == []
    held["artifacts"][0]["row_count"] = 4
    held["totals"]["rows"] = 4
    assert manifest.faults(a, held) == ["wrong row count x.parquet"]
    for target in (a, b):
        with pytest.raises(manifest.ManifestError, match="same|another"):
            manifest.copy_dataset(a, target, manifest.load(a / "manifest.json"))


@pytest.mark.parametrize("odd", [False, True])
def test_days_of_positions_are_no_lives_of_their_own(spark, monkeypatch, odd):
    d = "/root/testdata/sf0.001"
    prices = pool.price_logs(spark, d)
    if odd:  # the pools' times no longer follow their order
        prices = prices.withColumn("sec", F.when(F.col("k") % 5 == 0, F.col("sec") - 400_000).otherwise(F.col("sec")))
        monkeypatch.setattr(pool, "price_logs", lambda *_: prices)
    outside = pool.market(spark, d, prices)
    want = pool._panel(pool._days_by_life(pool.risk_positions(spark, d, outside), pool.pool_path(spark, d, prices, outside), outside, pool.pool_curve(spark, d))).orderBy("operation_id", "day").collect()
    if not odd:
        monkeypatch.setattr(pool, "life_costs", None)
    got = pool.risk_days(spark, d).orderBy("operation_id", "day").collect()
    assert len(got) == len(want) > 100
    for a, b in zip(got, want):
        assert tuple(a)[:4] == tuple(b)[:4]
        assert tuple(a)[4:] == pytest.approx(tuple(b)[4:], rel=1e-9, abs=1e-7 * b["liquidity"])
