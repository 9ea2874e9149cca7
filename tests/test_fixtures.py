"""Hand-made rows with known answers, and properties that SQL does not state."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickspark.operators import clean, ledger, pit, portfolio, strategy, technical
from tickspark.sources import io, views, records, wire


def series(spark, values, symbol=1):
    rows = [(symbol, datetime(2024, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol long, ts timestamp_ntz, close double")


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").collect()]


@pytest.mark.parametrize("block", [3, 4096])
def test_ema_equals_pandas_over_blocks_and_nulls(spark, block):
    x = [None, 5.0, 6.0, None, 4.0, 9.0, 1.0, 1.0, 3.0, None, 2.0]
    got = column(technical.block_recurrence(series(spark, x), "close", 0.5, "y", block_rows=block), "y")
    y, want = None, []
    for v in x:
        y = y if v is None else v if y is None else 0.5 * v + 0.5 * y
        want.append(y)
    assert got[0] is None and np.allclose(got[1:], want[1:])


def test_ema_of_whole_series(spark):
    x = np.random.default_rng(1).normal(10, 1, 50).tolist()
    got = column(technical.ema(series(spark, x), (12,)), "ema_12")
    assert np.allclose(got, pd.Series(x).ewm(span=12, adjust=False).mean())


def test_rsi_of_constant_and_rising_prices(spark):
    assert column(technical.rsi(series(spark, [5.0] * 20)), "rsi")[-1] is None
    assert column(technical.rsi(series(spark, [float(i) for i in range(20)])), "rsi")[-1] == 100.0


def test_interpolation_and_fills_of_null_runs(spark):
    x = series(spark, [None, 1.0, None, None, 4.0, None])
    assert column(clean.interpolate_linear(x, ["close"], order=("ts",)), "close") == [None, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert column(clean.forward_fill(x, ["close"], 1, order=("ts",)), "close") == [None, 1.0, 1.0, None, 4.0, 4.0]


def test_position_flip_through_zero():
    state, out = (0.0, 0.0, 0.0), []
    for trade in [(10, 100.0, "buy"), (10, 110.0, "buy"), (30, 120.0, "sell"), (10, 100.0, "buy")]:
        state, row = ledger.next_position(state, trade)
        out.append(row)
    assert out == [(10, 100.0, 0.0), (20, 105.0, 0.0), (-10, 120.0, 300.0), (0, 0.0, 500.0)]


def test_greedy_matching_break_blocks_its_key(spark):
    base = ("o", "s", "buy", "v")
    t = datetime(2024, 1, 1)
    a = spark.createDataFrame([("a1", *base, t, 5.0, 1.0), ("a2", *base, t + timedelta(seconds=1), 7.0, 1.0)], "fill_id string, order_id string, symbol string, side string, venue string, ts timestamp_ntz, quantity double, price double")
    b = a.withColumn("fill_id", F.concat(F.lit("x"), "fill_id")).filter("quantity = 7").unionByName(a.filter("quantity = 5").withColumn("fill_id", F.lit("xa1")))
    got = {tuple(r) for r in ledger.match_fills(a, b).collect()}
    assert got == {("a1", "xa1", "matched"), ("a2", "xa2", "matched")}
    late = b.withColumn("quantity", F.expr("case when fill_id = 'xa1' then 6 else quantity end"))
    assert {r.result for r in ledger.match_fills(a, late).collect()} == {"quantity"}


def test_point_in_time_never_looks_ahead(spark, small):
    e = views.ticks(spark, small).select(F.col("symbol").alias("entity_id"), "ts", "seq")
    f = e.select("entity_id", "ts", F.lit("p").alias("feature_name"), F.col("seq").cast("double").alias("value"), F.col("ts").alias("created_at"))
    early = f.filter("ts < timestamp_ntz '2024-01-15 00:00:00'")
    cut = e.filter("ts < timestamp_ntz '2024-01-15 00:00:00'")
    a = {tuple(r) for r in pit.point_in_time_join(cut, f, ["p"]).collect()}
    assert a == {tuple(r) for r in pit.point_in_time_join(cut, early, ["p"]).collect()}
    assert all(r[2] == r[3] for r in a)


def test_registry_orders_and_rejects_circles():
    reg = pit.FeatureRegistry()
    reg.register("a", lambda d: d, ("b",))
    reg.register("b", lambda d: d)
    assert reg.order(["a"]) == ["b", "a"]
    reg.register("b", lambda d: d, ("a",))
    with pytest.raises(ValueError):
        reg.order(["a"])


def test_backtest_cash_plus_position_is_equity(spark, small):
    bars = views.daily_bars(spark, small).selectExpr("symbol", "ts", "close", "close * 0.999 bid", "close * 1.001 ask").filter("symbol < 3")
    out = strategy.backtest(bars, strategy.param_grid(spark, {"lookback": [5], "entry": [0.5]})).join(bars, ["symbol", "ts"]).toPandas()
    assert np.allclose(out.cash + out.position * (out.bid + out.ask) / 2, out.equity) and out.traded.any()
    idle = strategy.backtest(bars, strategy.param_grid(spark, {"lookback": [5], "entry": [1e9]})).toPandas()
    assert (idle.equity == 1e6).all()



def test_granger_finds_the_driver(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = np.concatenate([[0], x[:-1]]) + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "symbol long, ts long, x double, y double")
    r = portfolio.granger(df, "y", ["x"], 2).first()
    assert r.best_lag == 1 and r.p < 1e-6


def test_wire_formats(spark, tmp_path):
    rec = np.array([(1, 1.5, 1.0, 2.0, 7, b"B"), (2, 2.5, 2.0, 3.0, 8, b"A")], records.TICK)
    (tmp_path / "t.bin").write_bytes(rec.tobytes() + b"xx")
    assert [tuple(r) for r in records.read_fixed_ticks(spark, str(tmp_path / "t.bin")).collect()] == [(1, 1.5, 1.0, 2.0, 7, "B"), (2, 2.5, 2.0, 3.0, 8, "A")]
    body = "8=FIX\u000135=8\u000137=x\u0001"
    good = f"{body}10={sum(body.encode()) % 256:03d}\u0001"
    df = spark.createDataFrame([(good,), (body + "10=999\u0001",), (None,)], "m string")
    assert [r[0] for r in df.select(wire.fix_checksum_ok(F.col("m"))).collect()] == [True, False, False]


def test_synthetic_ticks_are_the_same_for_a_seed(spark):
    a = io.synthetic_ticks(spark, 3, 50, 1)
    assert a.count() == 150 and a.filter("ask <= bid or volume < 1").count() == 0
    assert a.exceptAll(io.synthetic_ticks(spark, 3, 50, 1)).count() == 0
    assert io.synthetic_books(a, 4).filter("size(bid_prices) <> 4").count() == 0


def test_results_do_not_depend_on_partitions(spark, small):
    df = views.ticks(spark, small)
    a = {tuple(r) for r in technical.trailing_features(df, 86400).select("seq", "n", F.round("vwap", 6)).collect()}
    b = {tuple(r) for r in technical.trailing_features(df.repartition(5).orderBy(F.desc("seq")), 86400).select("seq", "n", F.round("vwap", 6)).collect()}
    assert a == b


def test_empty_frames(spark):
    empty = series(spark, []).withColumns({"volume": F.lit(1.0), "high": F.col("close"), "low": F.col("close"), "seq": F.lit(1)})
    assert technical.technical_all(empty).count() == 0
    assert technical.macd(empty).count() == 0
    assert clean.flag_outliers_iqr(empty, ["close"]).count() == 0


def test_weights_and_tails():
    assert np.allclose(portfolio.frac_diff_weights(1.0, 1e-5)[:2], [1, -1])
    assert abs(portfolio._beta_tail(4.0, 2, 10) - 0.0530) < 1e-3
