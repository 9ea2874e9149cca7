"""Series transforms against numpy, with distributed transforms of odd, even and prime lengths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.operators import spectral as S

LENGTHS = [1, 2, 3, 4, 5, 7, 8, 16, 31, 64, 97, 100, 243, 509, 600]


def series(n):
    rng = np.random.default_rng(n)
    return np.cumsum(rng.normal(size=n)) + 50


@pytest.fixture(scope="module")
def table(spark):
    rows = [(n, k, float(v)) for n in LENGTHS for k, v in enumerate(series(n))]
    return spark.createDataFrame(rows, "symbol int, t int, close double").selectExpr("symbol", "timestamp_seconds(t) ts", "close").repartition(5)


def by_series(df, cols, order="ts"):
    out = {}
    for r in df.orderBy("symbol", order).collect():
        out.setdefault(r.symbol, []).append([r[c] for c in cols])
    return {k: np.array(v, float) for k, v in out.items()}


@pytest.mark.parametrize("group", [1 << 16, 32])
def test_distributed_transform_equals_numpy(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    rng = np.random.default_rng(0)
    data = {n: rng.normal(size=n) + 1j * rng.normal(size=n) for n in LENGTHS}
    rows = [(n, n, k, float(z.real), float(z.imag)) for n, zs in data.items() for k, z in enumerate(zs)]
    df = spark.createDataFrame(rows, "symbol int, n long, i long, re double, im double")
    for longest in (0, 90):
        got = by_series(S.fourier(df, longest=longest), ["re", "im"], "i")
        assert set(got) == set(LENGTHS)
        for n, z in data.items():
            want = np.fft.fft(z)
            assert np.allclose(got[n][:, 0] + 1j * got[n][:, 1], want, atol=1e-9 * max(1, np.abs(want).max())), n


def numpy_analytic(x):
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def test_analytic_signal(table):
    for longest in (0, 1000):
        got = by_series(S.analytic_signal(table, longest=longest), ["amplitude", "phase"])
        for n in LENGTHS:
            z = numpy_analytic(series(n))
            assert np.allclose(got[n][:, 0] * np.exp(1j * got[n][:, 1]), z, atol=1e-8), n


def numpy_spectral(x):
    p, f = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2, np.fft.rfftfreq(len(x))[1:]
    p = p / p.sum()
    c = (f * p).sum()
    s = np.sqrt(((f - c) ** 2 * p).sum())
    return [c, s, ((f - c) ** 3 * p).sum() / s**3, ((f - c) ** 4 * p).sum() / s**4, -(p[p > 0] * np.log2(p[p > 0])).sum()]


def test_spectral_features(spark, table):
    flat = spark.createDataFrame([(-1, k, 5.0) for k in range(10)], "symbol int, t int, close double").selectExpr("symbol", "timestamp_seconds(t) ts", "close")
    got = {r.symbol: list(r)[1:] for r in S.spectral_features(table.unionByName(flat), longest=90).collect()}
    assert got[1] == got[-1] == [None] * 5
    for n in LENGTHS:
        if n > 4:
            assert np.allclose(np.array(got[n], float), numpy_spectral(series(n)), atol=1e-7), n


def numpy_decompose(x, period, multiplicative):
    n, half = len(x), period // 2
    kernel = np.ones(period) / period if period % 2 else np.concatenate([[0.5], np.ones(period - 1), [0.5]]) / period
    if n <= len(kernel):
        trend = np.full(n, x.mean())
    else:
        core = np.convolve(x, kernel, "valid")
        trend = np.concatenate([np.full(half, core[0]), core, np.full(n - len(core) - half, core[-1])])
    rest = x / trend if multiplicative else x - trend
    means = np.array([rest[k::period].mean() if k < n else 0.0 for k in range(period)])
    means = means / means.mean() if multiplicative else means - means.mean()
    seasonal = means[np.arange(n) % period]
    return np.array([trend, seasonal, rest / seasonal if multiplicative else rest - seasonal]).T


@pytest.mark.parametrize("period, multiplicative", [(7, False), (8, False), (8, True)])
def test_decomposition(table, period, multiplicative):
    got = by_series(S.seasonal_decompose(table, period, multiplicative), ["trend", "seasonal", "residual"])
    for n in LENGTHS:
        want = numpy_decompose(series(n), period, multiplicative)
        assert np.allclose(got[n], want, atol=1e-8), n


def test_strongest_period_decides(spark):
    x = {12: 10 + np.sin(2 * np.pi * np.arange(120) / 12), 5: 3 + np.cos(2 * np.pi * np.arange(100) / 5)}
    rows = [(k, t, float(v)) for k, xs in x.items() for t, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol int, t int, close double").selectExpr("symbol", "timestamp_seconds(t) ts", "close")
    assert {r.symbol: r.period for r in S.strongest_period(df, longest=50).collect()} == {12: 12, 5: 5}
    got = by_series(S.seasonal_decompose(df), ["trend", "seasonal", "residual"])
    for k, xs in x.items():
        assert np.allclose(got[k], numpy_decompose(xs, k, False), atol=1e-8)


def test_wavelets_rebuild_the_series(table):
    low, high = np.array(S.DB4), np.array(S.HIGH)
    got = by_series(S.wavelet_bank(table, block_rows=50), ["detail_1", "detail_2", "detail_3", "approximation"])
    for n in LENGTHS:
        x = a = series(n)
        details = []
        for k in range(3):
            at = (np.arange(n)[:, None] + 2**k * np.arange(8)[None, :]) % n
            details.append((a[at] * high / np.sqrt(2)).sum(1))
            a = (a[at] * low / np.sqrt(2)).sum(1)
        assert np.allclose(got[n], np.array([*details, a]).T, atol=1e-9), n
        # the adjoint filters give the values back
        back = got[n][:, 3]
        for k in reversed(range(3)):
            at = (np.arange(n)[:, None] - 2**k * np.arange(8)[None, :]) % n
            back = ((back[at] * low + got[n][:, k][at] * high) / np.sqrt(2)).sum(1)
        assert np.allclose(back, x, atol=1e-8), n


def test_nulls_and_empty_tables(spark, table):
    holes = table.withColumn("close", F.when(F.col("symbol") != 8, F.col("close")))
    for f in (S.analytic_signal, S.wavelet_bank, S.spectral_features, lambda d: S.seasonal_decompose(d, 4)):
        assert 8 not in {r.symbol for r in f(holes.filter("symbol in (7, 8)")).collect()}
        assert f(table.limit(0)).count() == 0
