"""What the findings of round 4 showed: one small case each."""

from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow as pa

from tickspark.functions import scratch
from tickspark.operators import pairs, portfolio
from tickspark.plans import all_queries


def odd_half(codes, seed: int, odd: bool) -> pairs._Half:
    """Series with gaps; of the odd ones some have nulls, infinite values, repeats, the values of another one, or do not vary."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in codes:
        own = np.random.default_rng(99) if odd and k % 11 == 4 else rng
        for t in np.flatnonzero(own.random(60) < 0.7):
            v = 7.3 if odd and k % 11 == 5 else own.normal(1000, 30)
            rows.append((k, t, np.inf if odd and k % 11 == 7 and t == 9 else v, not (odd and k % 11 == 3 and t % 8 == 0)))
            if odd and k % 11 == 6 and t == 20:
                rows.append((k, t, v + 1, True))
    code, t, v, ok = (np.array(c) for c in zip(*rows))
    v = np.where(ok, v.astype(float), 0.0)
    finite = ok & np.isfinite(v)
    mean = np.bincount(code[finite], v[finite], 60) / np.maximum(np.bincount(code[finite], minlength=60), 1)
    return pairs._Half(code.astype(np.int64), t.astype(np.int64), v, ok, np.where(ok, v - mean[code], 0.0))


def summed(left, right, whole: bool) -> dict:
    return {(left.symbols[a], right.symbols[b]): s[:, p, q] for i, j, s in pairs._tiles(left, right, whole, True) for p, a in enumerate(i) for q, b in enumerate(j) if s[0, p, q]}


def test_pair_sums_are_products_of_matrices(monkeypatch):
    """sums of dense series come from a few products; those by rows are the same, with nulls, repeats and infinite values."""
    called, by_rows = [], pairs._row_sums
    monkeypatch.setattr(pairs, "_row_sums", lambda *a: called.append(a[2]) or by_rows(*a))
    monkeypatch.setattr(pairs, "TILE", 8)
    for odd in (False, True):
        for whole in (False, True):
            left = odd_half(range(0, 52, 2), 1, odd)
            right = left if whole else odd_half(range(1, 52, 2), 2, odd)
            called.clear()
            with np.errstate(all="ignore"):
                dense = summed(left, right, whole)
                assert len(called) == sum(np.isinf(h.v).sum() for h in (left, right))
                with monkeypatch.context() as m:
                    m.setattr(pairs, "SPARSE", 0)
                    plain = summed(left, right, whole)
                with monkeypatch.context() as m:
                    m.setattr(pairs, "SLAB", 7)
                    slabs = summed(left, right, whole)
            assert dense.keys() == plain.keys() == slabs.keys() and len(dense) == (26 * 27 // 2 if whole else 26 * 26)
            for k in plain:
                assert np.allclose(dense[k], plain[k], rtol=1e-9, atol=1e-6, equal_nan=True) and np.allclose(slabs[k], plain[k], rtol=1e-9, atol=1e-6, equal_nan=True)


def test_a_series_is_exchanged_as_one_packed_row(spark):
    """a block's rows went to all its partners one by one; now a symbol's series is one row of bytes, also for the rows of pairs."""
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=i), None if i == s else float(i * s % 17)) for s in range(6) for i in range(50)]
    df = spark.createDataFrame(rows, "symbol long, ts timestamp_ntz, ret double").repartition(5)
    chunks, symbols, count = pairs._prepared(df, "ret")
    assert (symbols, count, chunks.count()) == (6, 300, 6)
    dealt = pairs._partitions(chunks, 3)
    assert dealt.count() == 18 and dict(dealt.dtypes)["v"] == "binary"
    got = {(r.s, t, v if ok else None) for r in chunks.collect() for t, v, ok in zip(*(x.tolist() for x in pairs._series(r.k, r.t, r.v, r.ok)))}
    assert got == {(s, int((t - datetime(1970, 1, 1)).total_seconds() * 1e6), v) for s, t, v in rows}
    assert pairs._sliced(4, chunks.columns) and pairs._partitions(chunks, 2, 4).selectExpr("sum(k)").first()[0] == 2 * 300


def by_pair(batches, at: int) -> dict:
    return {(r["a"], r["b"], *([r["ts"]] if at == 3 else [])): tuple(r.values())[at:] for b in batches for r in b.to_pylist()}


def test_rows_and_fits_of_pairs_are_those_of_each_row(monkeypatch):
    """common rows are found without sorting, and fitted in runs; doubtful pairs (equal series, constants) and odd ones go by rows."""
    order = pa.array(range(52))
    for odd in (False, True):
        for whole in (False, True):
            left = odd_half(range(0, 52, 2), 1, odd)
            right = left if whole else odd_half(range(1, 52, 2), 2, odd)
            by_rows, made = [], pairs._row_fits
            with np.errstate(all="ignore"), monkeypatch.context() as m:
                m.setattr(pairs, "_row_fits", lambda *a: by_rows.append(len(made(*a)[0])) or made(*a))
                m.setattr(pairs, "COMPARED", 200)
                fits, panel = by_pair(pairs._fits(25)(order, left, right, whole, {}), 2), list(pairs._panel(25)(order, left, right, whole, {}))
            want, rows = {}, {}
            with np.errstate(all="ignore"):
                for code, other, i, j in pairs._pair_rows(left, right, whole):
                    for o, *cells in zip(*made(code, other, left, right, i, j, 52, 25)):
                        want[min(code, o), max(code, o)] = cells
                    many = np.bincount(other, minlength=52)
                    for o, p, q in zip(other.tolist(), i.tolist(), j.tolist()):
                        if many[o] >= 25:
                            x, y = ((h.v[r] if h.ok[r] else None) for h, r in ((left, p), (right, q)))
                            rows.setdefault((min(code, o), max(code, o), int(left.t[p])), []).append((x, y) if code < o else (y, x))
            assert fits.keys() == want.keys() and sum(by_rows) < (len(want) if odd else 1)
            for k in want:
                assert np.allclose(fits[k], want[k], rtol=1e-7, atol=1e-7, equal_nan=True), k
            found: dict = {}
            for b in panel:
                for r in b.to_pylist():
                    found.setdefault((r["a"], r["b"], r["ts"]), []).append((r["x"], r["y"]))
            assert {k: sorted(v, key=str) for k, v in found.items()} == {k: sorted(v, key=str) for k, v in rows.items()}


def test_covariances_are_summed_where_they_are_made(spark):
    """covariances of all pairs were joined with both weights; portfolios and implied returns need none of them outside their task."""
    rng = np.random.default_rng(3)
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=i), None if (s + i) % 13 == 0 else float(rng.normal(0, 0.02))) for s in range(12) for i in range(40) if rng.random() < 0.8 and (s < 10 or i % 2 == s % 2)]
    rows += [rows[3], (20, datetime(2024, 1, 1), 0.01), (21, datetime(2030, 1, 1), 0.02)]
    returns = spark.createDataFrame(rows, "symbol long, ts timestamp_ntz, ret double").repartition(4).cache()
    held = [("p", s, 0.1 * s) for s in range(0, 12, 2)] + [("q", s, 1.0 - 0.2 * s) for s in range(9)] + [("q", 3, 0.5), ("q", 4, None), (None, 1, 1.0), ("only", 21, 1.0), ("none", 77, 1.0)]
    weights = spark.createDataFrame(held, "portfolio string, symbol long, weight double")
    caps = spark.createDataFrame([(s, 1.0 + s) for s in (*range(8), 20, 21, 77)] + [(2, 4.0), (5, None)], "symbol long, cap double")
    rows_of = lambda df: {r[0]: tuple(r)[1:] for r in df.collect()}
    mu, cov = portfolio.return_moments(returns)
    for blocks in (None, 1, 3):
        for got, want in (
            (portfolio.portfolio_stats_of_returns(returns, weights, blocks=blocks), portfolio.portfolio_stats(weights, mu, cov)),
            (portfolio.market_implied_of_returns(returns, caps, blocks=blocks), portfolio.market_implied_returns(caps, cov)),
        ):
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "[a#" not in plan and " a#" not in plan
            got, want = rows_of(got), rows_of(want)
            assert got.keys() == want.keys() and len(want) >= 3
            for k in want:
                assert all((x is None) == (y is None) and (x is None or np.isclose(x, y, rtol=1e-9, atol=1e-15, equal_nan=True)) for x, y in zip(got[k], want[k])), (k, got[k], want[k])


def test_series_too_long_for_one_task_keep_the_join(spark, monkeypatch):
    """where the sums of a pair come from several tasks, its covariance is made after them."""
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=i), float((i * (s + 3)) % 7)) for s in range(4) for i in range(40)]
    returns = spark.createDataFrame(rows, "symbol long, ts timestamp_ntz, ret double")
    weights = spark.createDataFrame([(1, s, 0.25) for s in range(4)], "portfolio int, symbol long, weight double")
    want = portfolio.portfolio_stats_of_returns(returns, weights).first()
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 9)
    assert pairs.weighted_variances(returns, "ret", weights, 2) is None
    got = portfolio.portfolio_stats_of_returns(returns, weights, blocks=2).first()
    assert np.allclose(got[1:], want[1:])


def test_a_join_of_streams_has_one_store_a_partition(spark, small):
    """both sides' rows and counts had four stores a partition, each written and committed by itself, and every write read its key first."""
    before = len(scratch._MADE)
    rows = all_queries()["st6_match_fills"](spark, small).count()
    state = next(p for p in scratch._MADE[before:] if "/stream-state-" in p).removeprefix("file:")
    parts = list(Path(state).glob("state/0/[0-9]*"))
    assert rows > 5000 and parts and not any((p / "left-keyToNumValues").exists() for p in parts)
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows") == "false"
