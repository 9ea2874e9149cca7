"""Plans and results of the steps that were rebuilt for larger tables."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from tickspark.operators import pairs, portfolio, technical


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_macd_of_many_keys_takes_one_exchange(spark):
    rng = np.random.default_rng(4)
    x = {s: rng.normal(100, 5, 40).tolist() for s in (None, 1, 2)}
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=i), v) for s, values in x.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol long, ts timestamp_ntz, close double").repartition(5)
    out = technical.macd(df)
    assert plan(out).count("hashpartitioning") == 1 and "FlatMapGroups" not in plan(out)
    found = pd.DataFrame(out.collect(), columns=out.columns)
    for s, values in x.items():
        v = pd.Series(values)
        want = v.ewm(span=12, adjust=False).mean() - v.ewm(span=26, adjust=False).mean()
        got = found[found.symbol.isna() if s is None else found.symbol == s].sort_values("ts")
        assert np.allclose(got.macd, want) and np.allclose(got.macd_signal, want.ewm(span=9, adjust=False).mean())


def test_pairs_meet_in_blocks_with_nulls_repeats_and_constants(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k, s in enumerate(("é", "b", "a", "c", "dd", "ä")):
        for i in range(40):
            if rng.random() < 0.8:
                v = 5.1 if s == "c" else float(rng.normal())
                rows.append((s, datetime(2024, 1, 1) + timedelta(days=i), None if rng.random() < 0.1 else v))
    rows += [rows[0], rows[50]]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double").repartition(4)
    t = pd.DataFrame(rows, columns=["s", "ts", "v"])
    both = t.merge(t, on="ts")
    both = both[both.s_x <= both.s_y]
    want = {k: g for k, g in both.groupby(["s_x", "s_y"])}
    for blocks in (None, 1, 3):
        cov = {(r.a, r.b): r for r in portfolio.return_moments(df, 1, blocks)[1].collect()}
        assert cov.keys() == want.keys()
        for k, g in want.items():
            assert cov[k].n == len(g)
            both_known = g.dropna()
            assert abs(cov[k].cov - np.cov(both_known.v_x, both_known.v_y)[0, 1]) < 1e-12
        panel = portfolio.pair_panel(df, "ret", 25, blocks)
        assert "SortMergeJoin" not in plan(panel) and "Window" not in plan(panel)
        got = sorted((r.a, r.b, r.ts, r.x is None, r.y is None, r.x or 0.0, r.y or 0.0) for r in panel.collect())
        kept = [g for (a, b), g in want.items() if a < b and len(g) >= 25]
        assert got == sorted((a, b, ts, x != x, y != y, 0.0 if x != x else x, 0.0 if y != y else y) for g in kept for a, ts, x, b, y in g[["s_x", "ts", "v_x", "s_y", "v_y"]].itertuples(index=False))
    distance = {(r.a, r.b): r.distance for r in portfolio.corr_distance(df).collect()}
    # as in the SQL, greatest() passes over the null correlation of a constant
    assert all((d == 0) == ("c" in k) for k, d in distance.items()) and len(distance) == 15


def test_pair_sums_by_slices_of_time_and_series_too_long_for_a_task(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=i), float(rng.normal(100, 3))) for s in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol long, ts timestamp_ntz, close double")
    sums = {(r.a, r.b): r.cov for r in pairs.pair_sums(df, "close").collect()}
    fits = {(r.a, r.b): r for r in portfolio.cointegration_of_series(df).collect()}
    panel = sorted(tuple(r) for r in portfolio.pair_panel(df, "close").collect())
    plain = {(r.a, r.b): r for r in portfolio.cointegration_scan(portfolio.pair_panel(df, "close")).collect()}
    assert fits.keys() == plain.keys() and all(np.allclose(fits[k][2:], plain[k][2:]) for k in fits)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 7)
    sliced = {(r.a, r.b): r.cov for r in pairs.pair_sums(df, "close", blocks=2).collect()}
    assert sliced.keys() == sums.keys() and all(abs(sliced[k] - sums[k]) < 1e-9 for k in sums)
    assert pairs.panel_rows(df, "close", 30, 2) is None
    assert sorted(tuple(r) for r in portfolio.pair_panel(df, "close", blocks=2).collect()) == panel


def test_ewm_volatility_weighs_by_rows_around_a_missing_return(spark):
    prices = [10.0, 11.0, 0.0, 9.0, 12.0, 11.5]
    df = spark.createDataFrame([(1, datetime(2024, 1, 1) + timedelta(days=i), i, p) for i, p in enumerate(prices)], "symbol long, ts timestamp_ntz, seq long, price double")
    got = [r.ewm_vol for r in technical.ewm_quote_volatility(df).orderBy("seq").collect()]
    r = {i: prices[i] / prices[i - 1] - 1 for i in range(1, 6) if prices[i - 1]}
    w = {i: (1 - 2 / 21) ** (5 - i) for i in r}
    m = sum(r.values()) / len(r)
    assert abs(got[-1] - (sum(w[i] * (r[i] - m) ** 2 for i in r) / sum(w.values())) ** 0.5) < 1e-12


def test_series_of_one_block_are_transformed_in_one_group(spark):
    from tickspark.operators import spectral

    rng = np.random.default_rng(6)
    n = {1: 331, 2: 40, 3: 512}
    rows = [(s, k, i, float(v), 0.0) for s, k in n.items() for i, v in enumerate(rng.normal(100, 1, k))]
    df = spark.createDataFrame(rows, "symbol long, n long, i long, re double, im double")
    out = spectral.fourier(df, longest=300, most=512)
    assert plan(out).count("FlatMapGroupsInPandas") == 1
    for s in n:
        x = np.array([r[3] for r in rows if r[0] == s])
        got = np.array([complex(r.re, r.im) for r in out.filter(f"symbol = {s}").orderBy("i").collect()])
        assert np.allclose(got, np.fft.fft(x), atol=1e-8)


def test_block_features_read_their_input_once(spark, small):
    from tickspark.sources import views

    out = technical.technical_all(views.daily_bars(spark, small), block_rows=30)
    assert "min_by" not in plan(out)
