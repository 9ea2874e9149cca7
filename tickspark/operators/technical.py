"""Rolling technical features; every frame partitions by symbol and orders by (ts, seq) or ts, so one exchange serves all."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.blocks import carried, in_blocks, largest_key, time_cuts
from ..functions.fold import same_key
from ..functions.scratch import stored
from ..functions.windows import BY, correlation, full, micros, ordered, ratio, rows, running

DAY = ("ts",)


def _prev(c: str | Column, k: int, by, order) -> Column:
    return F.lag(c, k).over(ordered(by, order))


def returns(df: DataFrame, periods: Iterable[int] = (1,), price: str = "close", by=BY, order=DAY) -> DataFrame:
    new = {}
    for k in periods:
        step = ratio(F.col(price), _prev(price, k, by, order))
        new |= {f"ret_{k}": step - 1, f"log_ret_{k}": F.ln(step)}
    return df.withColumns(new)


def momentum(df: DataFrame, windows: Iterable[int] = (5, 10), price: str = "close", by=BY, order=DAY) -> DataFrame:
    """Percent change and rate of change x 100."""
    change = {k: ratio(F.col(price), _prev(price, k, by, order)) - 1 for k in windows}
    return df.withColumns({f"mom_{k}": c for k, c in change.items()} | {f"roc_{k}": 100 * c for k, c in change.items()})


def sma(df: DataFrame, windows: Iterable[int] = (5, 20), price: str = "close", by=BY, order=DAY, cross: tuple[int, int] | None = None) -> DataFrame:
    """Mean over full windows and the relative distance to it; cross compares two means (null compares as 0)."""
    new = {}
    for n in windows:
        m = full(F.col(price), n, rows(n, by, order))
        new |= {f"sma_{n}": m, f"dist_sma_{n}": ratio(F.col(price), m) - 1}
    if cross:
        a, b = (full(F.col(price), n, rows(n, by, order)) for n in cross)
        new["golden_cross"] = F.coalesce((a > b).cast("int"), F.lit(0))
    return df.withColumns(new)


def volatility(df: DataFrame, windows: Iterable[int] = (20,), price: str = "close", by=BY, order=DAY) -> DataFrame:
    """Sample deviation of returns, annualised by 252 days, and Parkinson's from highs and lows."""
    df = df.withColumn("_r", ratio(F.col(price), _prev(price, 1, by, order)) - 1)
    new = {}
    for n in windows:
        s = full(F.col("_r"), n, rows(n, by, order), F.stddev_samp)
        park = full(F.pow(F.ln(ratio(F.col("high"), F.col("low"))), 2), n, rows(n, by, order))
        new |= {f"vol_{n}": s, f"ann_vol_{n}": s * F.sqrt(F.lit(252.0)), f"parkinson_{n}": F.sqrt(park / (4 * F.ln(F.lit(2.0))))}
    return df.withColumns(new).drop("_r")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, price: str = "close", by=BY, order=DAY) -> DataFrame:
    m, s = full(F.col(price), n, rows(n, by, order)), full(F.col(price), n, rows(n, by, order), F.stddev_samp)
    out = df.withColumns({"bb_mid": m, "_s": s})
    out = out.withColumns({"bb_upper": F.col("bb_mid") + k * F.col("_s"), "bb_lower": F.col("bb_mid") - k * F.col("_s")})
    width = F.col("bb_upper") - F.col("bb_lower")
    return out.withColumns({"bb_width": ratio(width, F.col("bb_mid")), "bb_pct": ratio(F.col(price) - F.col("bb_lower"), width)}).drop("_s")


def rsi(df: DataFrame, n: int = 14, price: str = "close", by=BY, order=DAY) -> DataFrame:
    """Simple means of gains and losses; the first row counts as no change; 100 without a loss, null without any move."""
    step = F.coalesce(F.col(price) - _prev(price, 1, by, order), F.lit(0.0))
    out = df.withColumns({"_g": F.greatest(step, F.lit(0.0)), "_l": F.greatest(-step, F.lit(0.0))})
    w = rows(n, by, order)
    out = out.withColumns({"_g": full(F.col("_g"), n, w), "_l": full(F.col("_l"), n, w)})
    value = F.when((F.col("_l") == 0) & (F.col("_g") > 0), 100.0).otherwise(100 - 100 / (1 + ratio(F.col("_g"), F.col("_l"))))
    return out.withColumn("rsi", value).drop("_g", "_l")


def atr(df: DataFrame, n: int = 14, by=BY, order=DAY) -> DataFrame:
    last = _prev("close", 1, by, order)
    out = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)))
    return out.withColumn("atr", full(F.col("_tr"), n, rows(n, by, order))).drop("_tr")


def vwap(df: DataFrame, n: int | None = None, by=BY, order=DAY) -> DataFrame:
    """Volume-weighted typical price, cumulative or over n rows, and the relative deviation of the close."""
    w = running(by, order) if n is None else rows(n, by, order)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = df.withColumn("vwap", ratio(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)))
    return out.withColumn("vwap_dev", ratio(F.col("close"), F.col("vwap")) - 1)


def volume_profile(df: DataFrame, windows: Iterable[int] = (5, 20), by=BY, order=DAY) -> DataFrame:
    new = {}
    for n in windows:
        w = rows(n, by, order)
        m = full(F.col("volume"), n, w)
        new |= {f"vol_mean_{n}": m, f"vol_ratio_{n}": ratio(F.col("volume"), m), f"vol_std_{n}": full(F.col("volume"), n, w, F.stddev_samp)}
    return df.withColumns(new)


def tick_features(df: DataFrame, by=BY, order=("ts", "seq")) -> DataFrame:
    """Spread in bps of price, order imbalance, one-tick return, 20-row deviation of price, 50-row mean volume."""
    return df.withColumns(
        {
            "spread_bps": 1e4 * ratio(F.col("ask") - F.col("bid"), F.col("price")),
            "imbalance": ratio(F.col("bid_size") - F.col("ask_size"), F.col("bid_size") + F.col("ask_size")),
            "tick_return": ratio(F.col("price"), _prev("price", 1, by, order)) - 1,
            "price_std_20": full(F.col("price"), 20, rows(20, by, order), F.stddev_samp),
            "volume_mean_50": full(F.col("volume"), 50, rows(50, by, order)),
        }
    )


def rolling_panel(df: DataFrame, windows: Iterable[int] = (5, 20, 60), by=BY, order=DAY) -> DataFrame:
    new = {}
    for n in windows:
        w = rows(n, by, order)
        new |= {f"close_mean_{n}": full(F.col("close"), n, w), f"close_std_{n}": full(F.col("close"), n, w, F.stddev_samp), f"volume_mean_{n}": full(F.col("volume"), n, w)}
    return df.withColumns(new)


def drawdown(df: DataFrame, equity: str = "equity", by=BY, order=DAY, from_returns: bool = False) -> DataFrame:
    """Running peak and relative drop, of an equity or of compounded returns (over -1)."""
    if from_returns:
        df = df.withColumn("_e", F.exp(F.sum(F.ln(1 + F.col(equity))).over(running(by, order))))
    else:
        df = df.withColumn("_e", F.col(equity))
    out = df.withColumn("peak", F.max("_e").over(running(by, order)))
    return out.withColumn("drawdown", ratio(F.col("_e"), F.col("peak")) - 1).drop("_e")


def regime_features(df: DataFrame, n: int = 20, ret: str = "ret", by=BY, order=DAY, block_rows: int = 4096) -> DataFrame:
    """Rolling deviation, mean, bias-corrected skew and excess kurtosis, lag-1 correlation and slope over full windows.

    A frame is not gone through again for each row and each moment: the sorted rows are read as one stream of at most `block_rows` at a
    time, with the last n - 1 before them, and the moments of all their frames are made at once.
    """
    names = ["roll_std", "roll_mean", "roll_skew", "roll_kurt", "autocorr", "slope"]
    by, keep = list(by), [c for c in df.columns if c not in names]
    schema = StructType([*(df.schema[c] for c in keep), *(StructField(c, DoubleType()) for c in names)])
    value = F.col(ret).cast("double")
    rows_ = df.withColumns({"_x": value, "_p": F.lag(value).over(ordered(by, order))}).sortWithinPartitions(*by, *order)
    lag = np.arange(n)[:, None] - (n - 1) / 2

    def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known, column.to_numpy(zero_copy_only=False), 0.0), known

    def frames(x: np.ndarray, p: np.ndarray, pair: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | bool]]:
        """Each feature of all frames, and where it is null though its frame is full."""
        m = len(x) - n + 1
        # less each frame's first value, so that nothing is left of values that do not vary
        d = np.array([x[k : k + m] - x[:m] for k in range(n)])
        mean = sum(x[k : k + m] for k in range(n)) / n
        c = d - d.mean(0)
        square = c * c
        c2, c3, c4 = square.mean(0), (square * c).mean(0), (square * square).mean(0)
        still = c2 == 0
        g1, g2 = c3 / c2**1.5, c4 / (c2 * c2) - 3
        # the value before the frame's first one may be missing
        e = np.concatenate([np.where(pair[:m], p[:m] - x[:m], 0.0)[None], d[:-1]])
        pairs = n - 1 + pair[:m]
        a, b = d - d.sum(0) / pairs, e - e.sum(0) / pairs
        a[0], b[0] = np.where(pair[:m], a[0], 0.0), np.where(pair[:m], b[0], 0.0)
        both = np.sqrt((a * a).sum(0) / pairs) * np.sqrt((b * b).sum(0) / pairs)
        return [
            (np.sqrt(c2 * n / (n - 1)), False), (mean, False), (g1 * (np.sqrt(n * (n - 1)) / (n - 2)), still), (((n + 1) * g2 + 6) * ((n - 1) / ((n - 2) * (n - 3))), still),
            ((a * b).sum(0) / pairs / both, both == 0), ((lag * c).sum(0) / (lag * lag).sum(), False),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, series = None, np.full(n - 1, -1)
        x, p, known, pair = np.zeros(n - 1), np.zeros(n - 1), np.zeros(n - 1, bool), np.zeros(n - 1, bool)
        for batch in (b.slice(k, block_rows) for b in batches for k in range(0, b.num_rows, block_rows)):
            fresh = np.zeros(batch.num_rows, bool)
            for c in by:
                fresh[1:] |= np.diff(batch.column(c).dictionary_encode("encode").indices.to_numpy()) != 0
            ends = [tuple(batch.column(c)[k].as_py() for c in by) for k in (0, -1)]
            fresh[0], key = not same_key(ends[0], key), ends[1]
            (x1, known1), (p1, pair1) = (plain(batch.column(c)) for c in ("_x", "_p"))
            x, p, known, pair = (np.concatenate(two) for two in ((x, x1), (p, p1), (known, known1), (pair, pair1)))
            series = np.concatenate([series, series[-1] + np.cumsum(fresh)])
            m = batch.num_rows
            counts = np.concatenate([[0], np.cumsum(known)])
            whole = (series[:m] == series[n - 1 :]) & (counts[n:] - counts[:m] == n)
            with np.errstate(all="ignore"):
                found = [pa.array(v, pa.float64(), mask=~whole | null) for v, null in frames(x, p, pair)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [f.name for f in schema])
            x, p, known, pair, series = (v[m:] for v in (x, p, known, pair, series))

    return rows_.mapInArrow(run, schema)


def create_lags(df: DataFrame, cols: list[str], lags: Iterable[int], by=BY, order=DAY) -> DataFrame:
    return df.withColumns({f"{c}_lag_{k}": _prev(c, k, by, order) for c in cols for k in lags})


def forward_label(df: DataFrame, horizon: int = 5, price: str = "close", by=BY, order=DAY) -> DataFrame:
    return df.withColumn("label", ratio(F.lead(price, horizon).over(ordered(by, order)), F.col(price)) - 1)


def rolling_zscore_signal(df: DataFrame, lookback: int = 20, col: str = "close", by=BY, order=DAY) -> DataFrame:
    """z of the newest value against the lookback - 1 before it (population deviation; 0 where it is zero), null until they are there."""
    w = ordered(by, order).rowsBetween(1 - lookback, -1)
    m, s = F.avg(col).over(w), F.stddev_pop(col).over(w)
    z = F.when(s == 0, 0.0).otherwise(ratio(F.col(col) - m, s))
    return df.withColumn("zscore", F.when(F.count(col).over(w) == lookback - 1, z))


def ewm_quote_volatility(df: DataFrame, span: int = 20, price: str = "price", by=BY, order=("ts", "seq")) -> DataFrame:
    """Exponentially weighted deviation around the plain mean of the last <= span returns."""
    a = 2.0 / (span + 1)
    df = df.withColumn("_r", ratio(F.col(price), _prev(price, 1, by, order)) - 1)
    # a missing return keeps its place, so that older ones are weighted by their distance in rows
    df = df.withColumn("_h", F.collect_list(F.struct("_r")).over(rows(span, by, order)))
    known = F.filter(F.transform("_h", lambda x, i: F.struct(x["_r"].alias("r"), F.pow(F.lit(1 - a), (F.size("_h") - 1 - i).cast("double")).alias("w"))), lambda x: x["r"].isNotNull())
    df = df.withColumn("_h", known)
    n = F.size("_h")
    mean = F.aggregate("_h", F.lit(0.0), lambda s, x: s + x["r"]) / F.nullif(n, F.lit(0))
    total = F.aggregate("_h", F.lit(0.0), lambda s, x: s + x["w"])
    df = df.withColumn("_m", mean)
    square = F.aggregate("_h", F.lit(0.0), lambda s, x: s + x["w"] * (x["r"] - F.col("_m")) * (x["r"] - F.col("_m")))
    return df.withColumn("ewm_vol", F.when(n > 1, F.sqrt(square / total))).drop("_r", "_h", "_m")


def recurrences(df: DataFrame, chain: list[tuple[str, str | tuple[str, str], float]], by=BY, order=DAY, block_rows: int = 65_536) -> DataFrame:
    """Adds (out, input, alpha): y = alpha x + (1 - alpha) y_before, y_first = x, over each series (nulls and NaN carry y on).

    An input is a column or a pair of earlier ones, whose difference it is.  Sorted rows are read as one stream of at most `block_rows` at a
    time with the last values of one key, so all of the chain takes one exchange and a series of any length needs no more memory.
    """
    plain = list(dict.fromkeys(x for _, x, _ in chain if isinstance(x, str) and x in df.columns))
    temporary = {c: f"_in_{k}" for k, c in enumerate(plain)}
    rows = df.withColumns({t: F.col(c).cast("double") for c, t in temporary.items()})
    schema = StructType([*df.schema.fields, *(StructField(out, DoubleType()) for out, _, _ in chain)])
    keep, by = list(df.columns), list(by)

    def smooth(x: list, fresh: list[bool], alpha: float, last: float | None) -> tuple[list, float | None]:
        out, q = [], 1.0 - alpha
        for v, new in zip(x, fresh):
            if new:
                last = None
            if v is not None and v == v:
                last = v if last is None else alpha * v + q * last
            out.append(last)
        return out, last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, {out: None for out, _, _ in chain}
        for batch in (b.slice(k, block_rows) for b in batches for k in range(0, b.num_rows, block_rows)):
            fresh = np.zeros(batch.num_rows, bool)
            for c in by:
                # equal codes for equal values, nulls among them
                fresh[1:] |= np.diff(batch.column(c).dictionary_encode("encode").indices.to_numpy()) != 0
            ends = [tuple(batch.column(c)[k].as_py() for c in by) for k in (0, -1)]
            fresh[0], key = not same_key(ends[0], key), ends[1]
            new, found = fresh.tolist(), {c: batch.column(t).to_pylist() for c, t in temporary.items()}
            for out, x, alpha in chain:
                if not isinstance(x, str):
                    found[x] = [None if a is None or b is None else a - b for a, b in zip(found[x[0]], found[x[1]])]
                found[out], last[out] = smooth(found[x], new, alpha, last[out])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(found[o], pa.float64()) for o, _, _ in chain)], [f.name for f in schema])

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def block_recurrence(df: DataFrame, col: str, alpha: float, out: str, by=BY, order=DAY, block_rows: int = 65_536) -> DataFrame:
    """One of `recurrences`."""
    return recurrences(df, [(out, col, alpha)], by, order, block_rows)


def ema(df: DataFrame, spans: Iterable[int] = (12, 26), col: str = "close", by=BY, order=DAY) -> DataFrame:
    return recurrences(df, [(f"ema_{n}", col, 2.0 / (n + 1)) for n in spans], by, order)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, col: str = "close", by=BY, order=DAY) -> DataFrame:
    means = [(f"ema_{n}", col, 2.0 / (n + 1)) for n in (fast, slow)]
    out = recurrences(df, [*means, ("macd_signal", (f"ema_{fast}", f"ema_{slow}"), 2.0 / (signal + 1))], by, order)
    out = out.withColumn("macd", F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop(f"ema_{fast}", f"ema_{slow}")


#: The widest frame of technical_all: 20 rows of returns, which look one row further back.
WIDEST = 21


def technical_all(df: DataFrame, by=BY, block_rows: int | None = None) -> DataFrame:
    """Returns, momentum, means, volatility, bands, RSI, ATR, VWAP and volume features in one frame over one exchange.

    With block_rows, symbols of more rows are dealt into blocks that overlap by the widest frame, and the cumulative
    VWAP comes from sums by time bucket, so that a dominant symbol is spread over many tasks.
    """
    steps = (returns, momentum, sma, volatility, bollinger, rsi, atr, vwap, volume_profile)
    if block_rows is None:
        return reduce(lambda d, f: f(d, by=by), steps, df)
    framed = [f for f in steps if f is not vwap]
    df = stored(df, "rows")
    out = in_blocks(df, lambda d, keys: reduce(lambda x, f: f(x, by=keys), framed, d), list(by), list(DAY), WIDEST, block_rows=block_rows)
    return vwap_of_buckets(out, by, DAY, block_rows, df)


def vwap_of_buckets(df: DataFrame, by=BY, order=DAY, block_rows: int = 100_000, counted: DataFrame | None = None) -> DataFrame:
    """The cumulative vwap and vwap_dev (see vwap) of symbols of any length, from sums by time bucket; `counted` has the same keys and times at less cost."""
    counted = df if counted is None else counted
    most = largest_key(counted, list(by))
    cuts = time_cuts(counted, order[0], min(2 + 2 * most // block_rows, 1000)) if most > block_rows else []
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = carried(df, list(by), list(order), {"_pv": typical * F.col("volume"), "_v": F.col("volume")}, cuts)
    out = out.withColumn("vwap", ratio(F.col("_pv"), F.col("_v"))).drop("_pv", "_v")
    return out.withColumn("vwap_dev", ratio(F.col("close"), F.col("vwap")) - 1)


# ---- microstructure


def order_flow_imbalance(df: DataFrame, n: int = 10, by=BY, order=("ts", "seq")) -> DataFrame:
    return df.withColumn("ofi", F.avg(ratio(F.col("bid_size") - F.col("ask_size"), F.col("bid_size") + F.col("ask_size"))).over(rows(n, by, order)))


def volume_order_imbalance(df: DataFrame, n: int = 10, by=BY, order=("ts", "seq")) -> DataFrame:
    """Sum over n rows of bid-size changes where mid is not down, less ask-size changes where it is not up."""
    mid = (F.col("bid") + F.col("ask")) / 2
    step = mid - F.lag(mid).over(ordered(by, order))
    bid = F.when(step >= 0, F.col("bid_size") - _prev("bid_size", 1, by, order)).otherwise(0.0)
    ask = F.when(step <= 0, F.col("ask_size") - _prev("ask_size", 1, by, order)).otherwise(0.0)
    return df.withColumn("_v", bid - ask).withColumn("voi", F.sum("_v").over(rows(n, by, order))).drop("_v")


def spreads(df: DataFrame) -> DataFrame:
    mid = (F.col("bid") + F.col("ask")) / 2
    quoted, effective = F.col("ask") - F.col("bid"), 2 * F.abs(F.col("price") - mid)
    return df.withColumns({"quoted": quoted, "quoted_bps": 1e4 * ratio(quoted, mid), "effective": effective, "effective_bps": 1e4 * ratio(effective, mid)})


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x)


def book_slope(df: DataFrame, depth: int = 5) -> DataFrame:
    """(best - last price of the depth) / total size, each side; one level gives 0."""

    def slope(side: str) -> Column:
        p, s = F.slice(f"{side}_prices", 1, depth), F.slice(f"{side}_sizes", 1, depth)
        return F.when(F.size(p) <= 1, 0.0).otherwise(ratio(F.abs(F.try_element_at(p, F.lit(1)) - F.try_element_at(p, F.lit(-1))), _total(s)))

    return df.withColumns({"bid_slope": slope("bid"), "ask_slope": slope("ask")})


def book_depth(df: DataFrame, depth: int = 5, distance_bps: float | None = None) -> DataFrame:
    mid = (F.try_element_at("bid_prices", F.lit(1)) + F.try_element_at("ask_prices", F.lit(1))) / 2

    def near(side: str) -> Column:
        level = F.slice(F.arrays_zip(F.col(f"{side}_prices").alias("p"), F.col(f"{side}_sizes").alias("s")), 1, depth)
        if distance_bps is not None:
            level = F.filter(level, lambda x: F.abs(x["p"] - mid) <= mid * distance_bps / 1e4)
        return F.aggregate(level, F.lit(0.0), lambda a, x: a + x["s"])

    return df.withColumns({"bid_depth": near("bid"), "ask_depth": near("ask")})


def best_quotes(df: DataFrame) -> DataFrame:
    bid, ask = F.try_element_at("bid_prices", F.lit(1)), F.try_element_at("ask_prices", F.lit(1))
    return df.withColumns({"best_bid": bid, "best_ask": ask, "mid": (bid + ask) / 2, "spread": ask - bid})


def trade_intensity(df: DataFrame, seconds: float, by=BY) -> DataFrame:
    """Rows in (t - seconds, t]."""
    w = Window.partitionBy(*by).orderBy(micros("ts")).rangeBetween(1 - int(seconds * 1e6), 0)
    return df.withColumn("trades", F.count("*").over(w))


def price_impact(df: DataFrame, n: int = 10, by=BY, order=("ts", "seq")) -> DataFrame:
    step = F.col("price") - _prev("price", 1, by, order)
    return df.withColumn("_i", ratio(step, F.sqrt("volume"))).withColumn("impact", full(F.col("_i"), n, rows(n, by, order))).drop("_i")


def realized_volatility(df: DataFrame, n: int = 20, by=BY, order=("ts", "seq")) -> DataFrame:
    df = df.withColumn("_r", ratio(F.col("price"), _prev("price", 1, by, order)) - 1)
    return df.withColumn("realized_vol", full(F.col("_r"), n, rows(n, by, order), F.stddev_samp) * F.sqrt(F.lit(252 * 6.5 * 3600))).drop("_r")


def trailing_features(df: DataFrame, seconds: float = 60.0, by=BY) -> DataFrame:
    """Over [t - seconds, t]: price mean, deviation (0 under two rows), range, count, size sum and mean, vwap, side imbalance."""
    w = Window.partitionBy(*by).orderBy(micros("ts")).rangeBetween(-int(seconds * 1e6), 0)
    buy = F.sum(F.when(F.col("side") == "B", F.col("size")).otherwise(0.0)).over(w)
    sell = F.sum(F.when(F.col("side") == "A", F.col("size")).otherwise(0.0)).over(w)
    return df.withColumns(
        {
            "price_mean": F.avg("price").over(w), "price_std": F.coalesce(F.stddev_samp("price").over(w), F.lit(0.0)), "price_min": F.min("price").over(w), "price_max": F.max("price").over(w),
            "n": F.count("*").over(w), "size_sum": F.sum("size").over(w), "size_mean": F.avg("size").over(w),
            "vwap": ratio(F.sum(F.col("price") * F.col("size")).over(w), F.sum("size").over(w)), "imbalance": ratio(buy - sell, buy + sell),
        }
    )


def book_from_ticks(df: DataFrame, levels: int = 5) -> DataFrame:
    """A deterministic book around each tick: prices at steps of 0.01, sizes from the tick's size and level."""
    i = F.sequence(F.lit(1), F.lit(levels))
    return df.select(
        "symbol", "ts", "seq", F.transform(i, lambda k: F.col("price") - 0.01 * k).alias("bid_prices"), F.transform(i, lambda k: F.col("size") + k).alias("bid_sizes"),
        F.transform(i, lambda k: F.col("price") + 0.01 * k).alias("ask_prices"), F.transform(i, lambda k: 2 * F.col("size") + k).alias("ask_sizes"),
    )


