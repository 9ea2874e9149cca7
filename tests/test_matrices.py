"""Wide correlations and regression factors against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickspark.operators import matrices as M
from tickspark.operators import portfolio as P


def test_five_hundred_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 500)) + rng.normal(size=(300, 500)) + 1e4
    x[:, 7] = 5.25
    x[rng.random(x.shape) < 0.05] = np.nan
    cols = [f"c{k}" for k in range(500)]
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in row) for row in x], ", ".join(f"{c} double" for c in cols)).repartition(6)
    got = P.correlation_matrix(df, cols)
    assert len(got._jdf.queryExecution().analyzed().toString()) < 200_000
    rows = got.collect()
    assert len(rows) == 500 * 499 // 2
    want = pd.DataFrame(x, columns=cols).corr()
    at = {c: k for k, c in enumerate(cols)}
    w = want.to_numpy()
    for r in rows:
        if "c7" in (r.feat_a, r.feat_b):
            assert r.corr is None
        else:
            assert at[r.feat_a] < at[r.feat_b] and abs(r.corr - w[at[r.feat_a], at[r.feat_b]]) < 1e-9


def test_tiles_of_any_size_and_empty_tables(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 7))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{k} double" for k in range(7)))
    want = np.corrcoef(x.T)
    monkeypatch.setattr(M, "PASS_BYTES", 1)  # one tile pair a pass
    got = {(r.feat_a, r.feat_b): r.corr for r in M.correlation_pairs(df, df.columns, tile=3).collect()}
    assert len(got) == 21 and all(abs(v - want[int(a[1:]), int(b[1:])]) < 1e-12 for (a, b), v in got.items())
    assert M.correlation_pairs(df.limit(0), df.columns, tile=3).filter("corr is not null").count() == 0


def panel(shift=0.0):
    rng = np.random.default_rng(8)
    rows = []
    for symbol in (1, 2):
        x, y = rng.normal(size=300), np.zeros(300)
        for t in range(2, 300):
            y[t] = 0.4 * y[t - 1] + (0.5 * x[t - 2] if symbol == 1 else 0) + 0.3 * rng.normal()
        rows += [(symbol, t, float(y[t] + shift), None if t == 50 else float(x[t] + shift)) for t in range(300)]
    return rows


def brute(rows, symbol, lag):
    t = pd.DataFrame([r for r in rows if r[0] == symbol], columns=["s", "t", "y", "x"])
    lags = pd.DataFrame({f"{c}{k}": t[c].shift(k) for c in "yx" for k in range(1, lag + 1)})
    ok = lags.notna().all(axis=1)
    y, z = t.y[ok].to_numpy(), lags[ok].to_numpy()
    # centred before the fit: the same residuals, no digits lost
    y, z = y - y.mean(), z - z.mean(0)
    rss = [((y - v @ np.linalg.lstsq(v, y, rcond=None)[0]) ** 2).sum() for v in (z[:, :lag], z)]
    return len(y), (rss[0] - rss[1]) / lag / (rss[1] / (len(y) - 2 * lag - 1))


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_factors_equal_least_squares(spark, shift):
    rows = panel(shift)
    df = spark.createDataFrame(rows, "symbol int, t int, y double, x double").selectExpr("symbol", "timestamp_seconds(t) ts", "y", "x")
    for block_rows in (40, 100_000):
        got = {(r.symbol, r.lag): (r.n, r.f) for r in M.lag_tests(df, "y", ["x"], 3, block_rows=block_rows).collect()}
        for symbol in (1, 2):
            for lag in (1, 2, 3):
                n, f = brute(rows, symbol, lag)
                assert got[symbol, lag][0] == n and abs(got[symbol, lag][1] / f - 1) < 1e-6
    best = {r.symbol: (r.best_lag, r.p) for r in P.granger(df, "y", ["x"], 3).collect()}
    assert best[1][0] == 2 and best[1][1] < 1e-20 and best[2][1] > 1e-4


def test_factor_keeps_the_gram_matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    df = spark.createDataFrame([(k % 3, list(map(float, v))) for k, v in enumerate(x)], "k int, v array<double>")
    for r in M.triangular_factors(df, ["k"], 4, block_rows=30).collect():
        f, own = np.array(r.r).reshape(4, 4), x[r.k :: 3]
        assert r.n == len(own) and np.allclose(np.tril(f, -1), 0) and np.allclose(f.T @ f, own.T @ own)


def test_too_few_rows(spark):
    df = spark.createDataFrame([(1, t, float(t), 1.0) for t in range(4)], "symbol int, t int, y double, x double").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.p for r in P.granger(df, "y", ["x"], 2).collect()] == [None]
    assert P.granger(df.limit(0), "y", ["x"], 2).collect() == []


def test_factors_of_runs_are_exchanged_and_no_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3)) + 1e5
    df = spark.createDataFrame([(None if k < 1000 else k // 1000, list(map(float, v))) for k, v in enumerate(x)], "k int, v array<double>").coalesce(1)
    made = M.triangular_factors(df, ["k"], 3, block_rows=500)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "FlatMapGroups" not in plan
    got = {r.k: r for r in made.collect()}
    assert set(got) == {None, 1, 2}
    for k, r in got.items():
        own, f = x[1000 * (k or 0) :][:1000], np.array(r.r).reshape(3, 3)
        assert r.n == 1000 and np.allclose(f.T @ f, own.T @ own, rtol=1e-12)


def test_a_lag_is_not_taken_over_nan_as_null(spark):
    rows = [(1, t, float(t * t % 11), float(t * 7 % 5)) for t in range(40)]
    df = spark.createDataFrame(rows, "symbol int, t int, y double, x double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    holes = df.withColumn("x", F.when(F.col("ts") != F.timestamp_seconds(F.lit(9)), F.col("x")))
    assert {(r.lag, r.n) for r in M.lag_tests(df, "y", ["x"], 2).collect()} == {(1, 39), (2, 38)}
    assert {(r.lag, r.n) for r in M.lag_tests(holes, "y", ["x"], 2, block_rows=7).collect()} == {(1, 38), (2, 36)}
