"""Matrix products and factors of tables of any length: Gram tiles for wide correlations, triangular factors for regressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import in_blocks
from ..functions.fold import same_key
from ..functions.scratch import stored

#: Bytes of tile sums that a task keeps at most in one pass.
PASS_BYTES = 256 << 20


def _columns(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The rows' arrays of `width` doubles as a matrix, NaN for null."""
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _passes(parts: int, tile: int) -> Iterator[list[tuple[int, int]]]:
    pairs = [(i, j) for i in range(parts) for j in range(i, parts)]
    step = max(1, PASS_BYTES // (6 * 8 * tile * tile))
    for k in range(0, len(pairs), step):
        yield pairs[k : k + step]


def correlation_pairs(df: DataFrame, cols: list[str], tile: int = 128) -> DataFrame:
    """(feat_a, feat_b, corr, n) of all pairs of columns in their order, over the rows in which both have a value.

    Rows less the columns' means become blocks of numpy rows; a task adds the products of two tiles of columns (values, squares and
    presence), tasks' sums of one tile pair are added in one stream, and each tile pair gives its rows.  A plan has a fixed
    number of expressions for any number of columns.  corr is null where one of the two does not vary.
    """
    width = len(cols)
    means = df.agg(*(F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{k}") for k, c in enumerate(cols))).first()
    mean = np.array([0.0 if m is None else m for m in means])
    rows = df.select(F.array(*(F.col(f"`{c}`").cast("double") for c in cols)).alias("v"))
    parts = -(-width // tile)
    out = None
    for pairs in _passes(parts, tile):
        found = _tile_pass(rows, cols, mean, tile, pairs)
        out = found if out is None else out.unionByName(found)
    return out


def _tile_pass(rows: DataFrame, cols: list[str], mean: np.ndarray, tile: int, pairs: list[tuple[int, int]]) -> DataFrame:
    width = len(cols)

    def cut(i: int) -> slice:
        return slice(i * tile, min((i + 1) * tile, width))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                x = _columns(batch.slice(at, 2048), width) - mean
                m = ~np.isnan(x)
                x, m = np.where(m, x, 0.0), m.astype(float)
                for i, j in pairs:
                    a, b, p, q = x[:, cut(i)], x[:, cut(j)], m[:, cut(i)], m[:, cut(j)]
                    new = np.array([a.T @ b, a.T @ q, p.T @ b, (a * a).T @ q, p.T @ (b * b), p.T @ q])
                    sums[i, j] = new if (i, j) not in sums else sums[i, j] + new
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["i", "j", "sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            for i, j, sums in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = np.frombuffer(sums).reshape(6, cut(i).stop - cut(i).start, cut(j).stop - cut(j).start)
                if key is not None and key != (i, j):
                    yield result(*key, held)
                    key = None
                key, held = ((i, j), own.copy()) if key is None else (key, held + own)
        if key is not None:
            yield result(*key, held)

    def result(i: int, j: int, s: np.ndarray) -> pa.RecordBatch:
        xy, x, y, xx, yy, n = s
        with np.errstate(divide="ignore", invalid="ignore"):
            cov, vx, vy = xy - x * y / n, xx - x * x / n, yy - y * y / n
            # what is left of a constant column's rounding is no variance
            ox, oy = ((np.abs(mean[cut(k)]) * 1e-14) ** 2 for k in (i, j))
            still = (vx <= n * ox[:, None]) | (vy <= n * oy[None, :]) | (n < 1)
            corr = cov / np.sqrt(vx * vy)
        a, b = np.meshgrid(np.arange(cut(i).start, cut(i).stop), np.arange(cut(j).start, cut(j).stop), indexing="ij")
        keep = a < b
        names = np.array(cols, object)
        columns = [pa.array(names[a[keep]], pa.string()), pa.array(names[b[keep]], pa.string()), pa.array(corr[keep], mask=still[keep]), pa.array(n[keep].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["feat_a", "feat_b", "corr", "n"])

    tiles = rows.mapInArrow(products, "i int, j int, sums binary")
    return tiles.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(merged, "feat_a string, feat_b string, corr double, n long")


def _runs(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin in a batch, and its length; nulls are equal."""
    fresh = np.zeros(batch.num_rows, bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= np.diff(batch.column(k).dictionary_encode("encode").indices.to_numpy()) != 0
    return np.append(np.flatnonzero(fresh), batch.num_rows)


def _factor(rows: np.ndarray) -> np.ndarray:
    """The upper triangular factor, of as many rows as the matrix has at most; few rows stand for themselves."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def _stacked(parts: DataFrame, keys: list[str], shape: dict[str, int] | int) -> DataFrame:
    """(keys, n, r) of each key's factors (keys, n, r), read as one sorted stream that holds one key's factor.

    A factor's width is the number given, or that of the value which its last key has there.
    """
    kinds = dict(parts.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, held = None, 0, None

        def whole(key: tuple) -> tuple:
            width = held.shape[1]
            r = np.zeros((width, width))
            own = np.linalg.qr(held, mode="r")
            r[: len(own)] = own
            return (*key, n, r.ravel())

        def table(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array([o[i] for o in out], like.schema.field(k).type) for i, k in enumerate(keys)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([o[-2] for o in out], pa.int64()), pa.array([o[-1] for o in out], pa.list_(pa.float64()))], names=[*keys, "n", "r"])

        batch = None
        for batch in batches:
            out = []
            lists, ends = batch.column("r"), batch.column("r").offsets.to_numpy()
            values, counts = lists.values.to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
            at = _runs(batch, keys)
            names = list(zip(*(batch.column(k).take(pa.array(at[:-1])).to_pylist() for k in keys)))
            for key, a, b in zip(names, at[:-1], at[1:]):
                width = shape if isinstance(shape, int) else shape[key[-1]]
                own = values[ends[a] : ends[b]].reshape(-1, width)
                if last is not None and same_key(key, last):
                    n, held = n + int(counts[a:b].sum()), _factor(np.concatenate([held, own]))
                    continue
                if last is not None:
                    out.append(whole(last))
                last, n, held = key, int(counts[a:b].sum()), _factor(own)
            if out:
                yield table(out, batch)
        if last is not None:
            yield table([whole(last)], batch)

    dealt = parts.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(merged, head + ", n long, r array<double>")


def triangular_factors(rows: DataFrame, keys: list[str], width: int, block_rows: int = 100_000) -> DataFrame:
    """(keys, n, r) of rows (keys, v): the upper triangular factor of each key's matrix whose rows are the arrays v of `width` doubles.

    Runs of a key's rows, at most `block_rows` long, are factored where they are, and only factors are exchanged, stacked and factored
    again; no cross-products are formed, so nothing is lost to large means.
    """
    kinds = dict(rows.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, block_rows) for b in batches for k in range(0, b.num_rows, block_rows)):
            at = _runs(batch, keys)
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            first = pa.array(at[:-1])
            r = [_factor(v[a:b]).ravel() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(first) for k in keys), pa.array(np.diff(at)), pa.array(r, pa.list_(pa.float64()))], names=[*keys, "n", "r"])

    return _stacked(rows.select(*keys, "v").mapInArrow(local, head + ", n long, r array<double>"), keys, width)


def lag_tests(df: DataFrame, target: str, cols: list[str], max_lag: int = 3, by: str = "symbol", order=("ts",), block_rows: int = 100_000) -> DataFrame:
    """(by, feature, lag, n, f): the F statistic of adding `lag` lags of a feature to as many of the target, over rows that have them all.

    Both fits are read from one triangular factor of (1, target's lags, feature's lags, target).  f is null without a free
    degree or if nothing is left to explain.  The rows are stored once, as blocks read them several times; the sorted rows of a
    window give the factors of all lags and features in one stream, and only those are exchanged.
    """
    w = lambda keys: Window.partitionBy(*keys).orderBy(*order)
    kind = dict(df.dtypes)[by]
    names = list(dict.fromkeys([target, *cols]))
    span = max_lag + 1

    def lagged(d: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        # each column's value and lags, side by side
        past = [F.col(f"`{c}`").cast("double") if k == 0 else F.lag(F.col(f"`{c}`").cast("double"), k).over(w(keys)) for c in names for k in range(span)]
        return d.withColumn("_v", F.array(*past))

    base = stored(df.select(by, *order, *names), "lags")
    rows = in_blocks(base, lagged, [by], list(order), max_lag, block_rows=max(block_rows, max_lag))
    tests = [(c, lag) for c in cols for lag in range(1, span)]
    of = {c: k * span for k, c in enumerate(names)}
    use = [[*range(of[target] + 1, of[target] + 1 + lag), *range(of[c] + 1, of[c] + 1 + lag), of[target]] for c, lag in tests]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _runs(batch, [by])
            x = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(names) * span)
            # a null is NaN here, a NaN is a value
            known = batch.column("_v").flatten().is_valid().to_numpy(zero_copy_only=False).reshape(x.shape)
            run, feature, lags, n, r = [], [], [], [], []
            for (c, lag), columns in zip(tests, use):
                whole = known[:, columns].all(1)
                m = np.ones((len(x), len(columns) + 1))
                m[:, 1:] = x[:, columns]
                for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    own = m[a:b][whole[a:b]]
                    if len(own):
                        run.append(at[i])
                        feature.append(c)
                        lags.append(lag)
                        n.append(len(own))
                        r.append(_factor(own).ravel())
            columns = [batch.column(by).take(pa.array(run, pa.int64())), pa.array(feature, pa.string()), pa.array(lags, pa.int32()), pa.array(n, pa.int64()), pa.array(r, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[by, "feature", "lag", "n", "r"])

    parts = rows.select(by, "_v").mapInArrow(local, f"`{by}` {kind}, feature string, lag int, n long, r array<double>")
    factors = _stacked(parts, [by, "feature", "lag"], {lag: 2 * lag + 2 for lag in range(1, span)})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            f = []
            for lag, n, r in zip(t["lag"], t["n"], t["r"]):
                width = 2 * lag + 2
                r = np.array(r).reshape(width, width)
                left = []
                for k in (lag + 1, 2 * lag + 1):
                    beta = np.linalg.lstsq(r[:, :k], r[:, -1], rcond=None)[0]
                    left.append(float(((r[:, :k] @ beta - r[:, -1]) ** 2).sum()))
                free = n - 2 * lag - 1
                f.append((left[0] - left[1]) / lag / (left[1] / free) if free > 0 and left[1] > 1e-12 else None)
            yield t[[by, "feature", "lag", "n"]].assign(f=pd.Series(f, t.index, dtype=float))

    return factors.mapInPandas(solve, f"`{by}` {kind}, feature string, lag int, n long, f double")
