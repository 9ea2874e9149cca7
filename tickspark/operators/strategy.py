"""Signals, backtests, sweeps, validation splits, execution schedules and risk screening."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from inspect import signature

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fold import ordered_fold
from ..functions.windows import micros, ratio
from .technical import rolling_zscore_signal


def mean_reversion_signal(df: DataFrame, col: str = "close", entry: float = 2.0, leave: float = 0.5, by: str = "symbol", order=("ts",)) -> DataFrame:
    """Position -1, 0, 1 from the global z-score: enters beyond +-entry, leaves where abs z < leave, no direct flip.

    A segment runs from one leaving bar to the next, and its state is its first entry: pure windows.
    """
    s = df.groupBy(by).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    z = df.join(s, by).withColumn("zscore", ratio(F.col(col) - F.col("_m"), F.col("_s")))
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    z = z.withColumn("_seg", F.sum(F.when(F.abs("zscore") < leave, 1).otherwise(0)).over(w))
    enter = F.when(F.col("zscore") > entry, -1).when(F.col("zscore") < -entry, 1)
    inside = Window.partitionBy(by, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return z.withColumn("position", F.coalesce(F.first(enter, ignorenulls=True).over(inside), F.lit(0))).drop("_m", "_s", "_seg")


def momentum_positions(df: DataFrame, lookback: int = 20, entry: float = 1.0, stop: float = 0.05, price: str = "close", by: str = "symbol") -> DataFrame:
    """Position by the z of the newest return: enters at +-entry, leaves when the sign turns or the loss from the entry price passes stop."""
    last = F.lag(price).over(Window.partitionBy(by).orderBy("ts"))
    base = df.withColumn("_ret", ratio(F.col(price), last) - 1)
    base = rolling_zscore_signal(base, lookback, "_ret", (by,), ("ts",)).withColumn("_z", F.coalesce("zscore", F.lit(0.0))).drop("_ret", "zscore")

    def step(state: tuple, row: tuple) -> tuple:
        pos, paid = state
        p, z = row
        if pos == 0:
            if abs(z) > entry:
                pos, paid = (1 if z > 0 else -1), p
        elif pos * z < 0 or (paid and pos * (p / paid - 1) < -stop):
            pos, paid = 0, 0.0
        return (pos, paid), (pos, paid)

    return ordered_fold(base, [by], ["ts"], lambda: (0, 0.0), step, [price, "_z"], "position int, entry_price double").drop("_z")


def pairs_positions(df: DataFrame, entry: float = 2.0, leave: float = 0.5, z: str = "zscore", by: str = "symbol") -> DataFrame:
    """Position by a spread's z: short over entry, long under -entry; a long leaves over -leave, a short under leave."""

    def step(pos: int, row: tuple) -> tuple:
        v = row[0]
        if v is None or v != v:
            return pos, (pos,)
        if pos == 0:
            pos = -1 if v > entry else 1 if v < -entry else 0
        elif (pos == 1 and v > -leave) or (pos == -1 and v < leave):
            pos = 0
        return pos, (pos,)

    return ordered_fold(df, [by], ["ts"], lambda: 0, step, [z], "position int")


#: Positions from one key's bars in time order and the parameters; one that takes a third argument is given bars of many keys and each row's key number.
Strategy = Callable[..., pd.Series]

#: Bars that a task holds at once at least, whole keys; a longer key is held whole.
BARS_AT_ONCE = 100_000


def threshold_strategy(bars: pd.DataFrame, params: dict, keys: np.ndarray | None = None) -> pd.Series:
    """Long below, short above a number of deviations from the mean of the bars before (built-in example)."""
    n = int(params["lookback"])
    if keys is None:
        past = bars["close"].shift(1).rolling(n)
    else:
        past = bars["close"].groupby(keys).shift(1).groupby(keys).rolling(n)
    mean, std = past.mean().to_numpy(), past.std().replace(0, np.nan).to_numpy()
    with np.errstate(invalid="ignore"):
        z = (bars["close"].to_numpy() - mean) / std
        return pd.Series(np.where(z > params["entry"], -1, np.where(z < -params["entry"], 1, 0)), index=bars.index)


def simulate(bars: pd.DataFrame, target: np.ndarray, cash: float, size: float, commission: float, slippage_bps: float, starts: np.ndarray | None = None) -> pd.DataFrame:
    """Cash, position and equity per bar: buys at the ask, sells at the bid, each moved by the slippage; cost in shares of notional.

    With starts, the bars are those of several keys, which begin there.
    """
    starts = np.zeros(min(1, len(bars)), int) if starts is None else starts
    want = target * size
    held = np.concatenate([[0.0], want[:-1]])[: len(want)]
    held[starts] = 0.0
    trade = want - held
    slip = slippage_bps / 1e4
    price = np.where(trade > 0, bars["ask"].to_numpy() * (1 + slip), bars["bid"].to_numpy() * (1 - slip))
    flow = -trade * price - np.abs(trade) * price * commission
    money = np.empty(len(flow))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(flow)]):
        np.cumsum(flow[a:b], out=money[a:b])
    money += cash
    mark = (bars["bid"].to_numpy() + bars["ask"].to_numpy()) / 2
    return bars[["ts"]].assign(position=want, cash=money, equity=money + want * mark, traded=np.abs(trade) > 0)


def _whole_keys(batches: Iterator[pd.DataFrame], by: str) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(rows, key number of each, where each key begins) of batches sorted by key: whole keys, about BARS_AT_ONCE rows."""

    def numbered(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        rows = pd.concat(parts, ignore_index=True)
        keys = pd.factorize(rows[by], use_na_sentinel=False)[0]
        return rows, keys, np.flatnonzero(np.diff(keys, prepend=-1))

    held, n, most = [], 0, BARS_AT_ONCE
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += len(batch)
        if n >= most:
            rows, keys, starts = numbered(held)
            cut = int(starts[-1])
            if cut:
                yield rows.iloc[:cut], keys[:cut], starts[:-1]
            held, n = [rows.iloc[cut:]], len(rows) - cut
            most = max(BARS_AT_ONCE, 2 * n)  # a long key is not put together again for each batch
    if n:
        yield numbered(held)


def _curves(bars: DataFrame, grid: DataFrame, strategy: Strategy, cash: float, size: float, commission: float, slippage_bps: float, by: str, fields: str, finish: Callable[[pd.DataFrame, pd.Series, np.ndarray], pd.DataFrame]) -> DataFrame:
    """finish(curve, keys' values, starts) of every parameter set on every key, as (run, `fields`).

    Bars are dealt by key once for all parameter sets and read as one sorted stream, so that many short keys cost no call each.
    """
    runs = [(r["run"], dict(r["params"])) for r in grid.collect()]  # a small, given list
    many = len(signature(strategy).parameters) > 2

    def positions(t: pd.DataFrame, params: dict, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if many:
            return np.asarray(strategy(t, params, keys), float)
        ends = [*starts[1:].tolist(), len(t)]
        return np.concatenate([np.asarray(strategy(t.iloc[a:b].reset_index(drop=True), params), float) for a, b in zip(starts.tolist(), ends)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t, keys, starts in _whole_keys(batches, by):
            for number, params in runs:
                curve = simulate(t, positions(t, params, keys, starts), cash, size, commission, slippage_bps, starts)
                out = finish(curve, t[by], starts)
                out.insert(0, "run", number)
                yield out

    narrow = bars.select(by, "ts", "close", "bid", "ask").repartition(by).sortWithinPartitions(by, "ts")
    return narrow.mapInPandas(run, f"run long, {fields}")


def backtest(bars: DataFrame, grid: DataFrame, strategy: Strategy = threshold_strategy, cash: float = 1e6, size: float = 100.0, commission: float = 0.0005, slippage_bps: float = 1.0, by: str = "symbol") -> DataFrame:
    """(run, symbol, ts, position, cash, equity, traded) of every parameter set (run, params map) on every symbol."""
    kind = dict(bars.dtypes)[by], dict(bars.dtypes)["ts"]

    def finish(curve: pd.DataFrame, keys: pd.Series, starts: np.ndarray) -> pd.DataFrame:
        return curve.assign(**{by: keys})[[by, "ts", "position", "cash", "equity", "traded"]]

    fields = f"`{by}` {kind[0]}, ts {kind[1]}, position double, cash double, equity double, traded boolean"
    return _curves(bars, grid, strategy, cash, size, commission, slippage_bps, by, fields, finish)


def sweep(bars: DataFrame, grid: DataFrame, strategy: Strategy = threshold_strategy, by: str = "symbol", cash: float = 1e6, size: float = 100.0, commission: float = 0.0005, slippage_bps: float = 1.0) -> DataFrame:
    """Each run's result over all symbols, best Sharpe first (see aggregate_sweep, rank_runs)."""
    from .portfolio import aggregate_sweep, rank_runs

    def finish(curve: pd.DataFrame, keys: pd.Series, starts: np.ndarray) -> pd.DataFrame:
        equity, money = curve["equity"].to_numpy(), curve["cash"].to_numpy()
        before = np.concatenate([[np.nan], equity[:-1]])
        before[starts] = np.nan
        first = np.repeat(money[starts], np.diff([*starts, len(curve)]))
        with np.errstate(divide="ignore", invalid="ignore"):
            ret = np.where(before != 0, equity / before - 1, 0.0)
        return pd.DataFrame({"ts": curve["ts"], "pnl": equity - np.where(np.isnan(before), first, before), "ret": np.where(np.isnan(ret), 0.0, ret), "trades": curve["traded"].astype("int64")})

    fields = f"ts {dict(bars.dtypes)['ts']}, pnl double, ret double, trades long"
    return rank_runs(aggregate_sweep(_curves(bars, grid, strategy, cash, size, commission, slippage_bps, by, fields, finish)))


def param_grid(spark: SparkSession, params: dict[str, list[float]]) -> DataFrame:
    """(run, params map) of the Cartesian grid, in the order of the given lists."""
    rows = [(i, dict(zip(params, map(float, v)))) for i, v in enumerate(itertools.product(*params.values()))]
    return spark.createDataFrame(rows, "run long, params map<string,double>")


def param_random(spark: SparkSession, ranges: dict[str, tuple[float, float]], n: int, seed: int = 0) -> DataFrame:
    """(run, params map) of uniform samples, the same for a seed."""
    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    cells = [x for k, (a, b) in ranges.items() for x in (F.lit(k), F.lit(float(a)) + unit(k) * (b - a))]
    return spark.range(n).select(F.col("id").alias("run"), F.create_map(*cells).alias("params"))


def sweep_cross(grid: DataFrame, symbols: DataFrame, start: str, end: str, step: str) -> DataFrame:
    """Grid x symbols x time chunks, as work items."""
    chunk = F.explode(F.expr(f"sequence(timestamp_ntz '{start}', timestamp_ntz '{end}', interval {step})")).alias("chunk_start")
    return symbols.select("symbol").distinct().crossJoin(F.broadcast(grid.select("run"))).select("run", "symbol", chunk)


def walk_forward_windows(spark: SparkSession, start: str, end: str, train_days: int, test_days: int, anchored: bool = False) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end): the next window starts where the last test ends."""
    return _windows(spark.range(1).selectExpr(f"timestamp_ntz '{start}' a", f"timestamp_ntz '{end}' b"), train_days, test_days, anchored)


def walk_forward_of(df: DataFrame, train_days: int, test_days: int, anchored: bool = False, ts: str = "ts") -> DataFrame:
    """walk_forward_windows from the first to the last time of the rows."""
    return _windows(df.agg(F.min(ts).cast("timestamp_ntz").alias("a"), F.max(ts).cast("timestamp_ntz").alias("b")), train_days, test_days, anchored)


def _windows(ends: DataFrame, train_days: int, test_days: int, anchored: bool) -> DataFrame:
    """Windows of one row (a, b); none where the time is too short."""
    long = ends.filter(f"a + interval {train_days} days <= b - interval {test_days} days")
    one = long.selectExpr("a", f"explode(sequence(a + interval {train_days} days, b - interval {test_days} days, interval {test_days} days)) test_start")
    begin = F.col("a") if anchored else F.expr(f"test_start - interval {train_days} days")
    return one.select(
        (F.row_number().over(Window.orderBy("test_start")) - 1).alias("fold"), begin.alias("train_start"), F.col("test_start").alias("train_end"), "test_start", F.expr(f"test_start + interval {test_days} days").alias("test_end")
    )


def assign_windows(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows with their fold and part (train or test), once for each window that holds them."""
    w = F.broadcast(windows)  # few rows
    hit = (df["ts"] >= w["train_start"]) & (df["ts"] < w["test_end"])
    return df.join(w, hit).withColumn("part", F.when(F.col("ts") < F.col("train_end"), "train").otherwise("test")).drop("train_start", "train_end", "test_start", "test_end")


def purged_cv_assign(df: DataFrame, n: int = 5, embargo: int = 5, by: str = "symbol", order=("ts",)) -> DataFrame:
    """Row-index folds (the last takes the rest): one row per row and fold with part test, train, or none in the embargo after a test."""
    size = df.groupBy(by).agg(F.count("*").alias("_c"))
    rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).join(size, by)
    rows = rows.withColumn("_len", F.greatest(F.floor(F.col("_c") / n), F.lit(1))).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    a = F.col("fold") * F.col("_len")
    b = F.when(F.col("fold") == n - 1, F.col("_c")).otherwise(a + F.col("_len"))
    part = F.when((F.col("_i") >= a) & (F.col("_i") < b), "test").when((F.col("_i") >= b) & (F.col("_i") < b + embargo), "embargo").otherwise("train")
    return rows.withColumn("part", part).drop("_i", "_c", "_len")


# ---- execution schedules: (order_id, slice, ..., quantity)


def twap_schedule(orders: DataFrame, n: int, step_s: float) -> DataFrame:
    out = orders.select("order_id", "ts", "quantity", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slice"))
    at = F.timestamp_micros((micros("ts") + F.col("slice") * int(step_s * 1e6)).cast("long")).cast("timestamp_ntz")
    return out.select("order_id", "slice", at.alias("at"), (F.col("quantity") / n).alias("quantity"))


def vwap_schedule(orders: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """Slices in proportion to the volume of n equal runs of the symbol's bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    c = bars.groupBy("symbol").agg(F.count("*").alias("_c"), F.sum("volume").alias("_v"))
    b = bars.withColumn("_i", F.row_number().over(w) - 1).join(c, "symbol").withColumn("slice", F.least(F.floor(F.col("_i") * n / F.col("_c")), F.lit(n - 1)).cast("int"))
    share = b.groupBy("symbol", "slice").agg(ratio(F.sum("volume"), F.first("_v")).alias("_s"))
    return orders.join(share, "symbol").select("order_id", "slice", (F.col("quantity") * F.col("_s")).alias("quantity"))


def pov_schedule(orders: DataFrame, adv: DataFrame, pov: float = 0.1, most: float = 0.2, slices: int = 100) -> DataFrame:
    """Slices of min(what is left, adv x pov, adv x most), at most so many."""
    j = orders.join(adv, "symbol").withColumn("_each", F.col("adv") * min(pov, most)).filter("_each > 0")
    j = j.withColumn("_n", F.least(F.ceil(F.col("quantity") / F.col("_each")), F.lit(slices)))
    out = j.filter("_n > 0").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return out.select("order_id", F.col("slice").cast("int").alias("slice"), F.least(F.col("_each"), F.col("quantity") - F.col("slice") * F.col("_each")).alias("quantity"))


def is_schedule(orders: DataFrame, n: int = 10, kappa: float = 0.5, horizon: float = 1.0) -> DataFrame:
    """Implementation shortfall: q sinh(k (T - t)) / sinh(k T) dt / T at n times (they do not add up to q)."""
    dt = horizon / n
    out = orders.select("order_id", "quantity", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slice"))
    weight = F.sinh(kappa * (F.lit(horizon) - F.col("slice") * dt)) / F.sinh(F.lit(kappa * horizon))
    return out.select("order_id", "slice", (F.col("quantity") * weight * dt / horizon).alias("quantity"))


def adaptive_route(orders: DataFrame, market: DataFrame) -> DataFrame:
    """The schedule of each order: urgent ones TWAP, volatile symbols IS, large volume POV, else VWAP."""
    route = F.when(F.col("urgency") > 0.8, "twap").when(F.col("volatility") > 0.02, "is").when(F.col("avg_volume") > 10 * F.col("quantity"), "pov").otherwise("vwap")
    return orders.join(market, "symbol", "left").withColumn("route", route)


def adaptive_schedule(orders: DataFrame, market: DataFrame, bars: DataFrame, n: int = 10) -> DataFrame:
    routed = adaptive_route(orders, market)
    pick = lambda r: routed.filter(F.col("route") == r).select(orders.columns)
    parts = [
        twap_schedule(pick("twap"), 5, 60).drop("at"), is_schedule(pick("is"), n), vwap_schedule(pick("vwap"), bars, n),
        pov_schedule(pick("pov"), market.select("symbol", F.col("avg_volume").alias("adv"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- risk


def order_rate(orders: DataFrame, short_s: float = 1.0, long_s: float = 60.0, by: str = "entity") -> DataFrame:
    """Orders offered in the trailing windows (t - s, t]."""
    w = lambda s: Window.partitionBy(by).orderBy(micros("ts")).rangeBetween(1 - int(s * 1e6), 0)
    return orders.withColumns({"rate_short": F.count("*").over(w(short_s)), "rate_long": F.count("*").over(w(long_s))})


def accepted_rate(orders: DataFrame, limit: int, seconds: float, by: str = "entity", order=("ts", "order_id")) -> DataFrame:
    """throttled: the order would pass the limit of accepted orders in the trailing window (a throttled one is not counted)."""
    base = orders.withColumn("_us", micros("ts"))

    def step(kept: list, row: tuple) -> tuple:
        kept = [t for t in kept if t > row[0] - seconds * 1e6]
        full = len(kept) >= limit
        return (kept if full else [*kept, row[0]]), (full,)

    return ordered_fold(base, [by], list(order), list, step, ["_us"], "throttled boolean").drop("_us")


def screen_orders(orders: DataFrame, state: DataFrame, limits: dict, extra: list[tuple[Column, str, str]] = (), by: str = "entity") -> DataFrame:
    """decision, reason: the first check that fails wins: kill switch, rate, size, fat finger, position, daily loss, drawdown, leverage.

    orders: entity, quantity, price, ref_price, rate; state: entity, position, equity, peak_equity, daily_pnl, gross, killed.
    extra: user-defined checks (condition, decision, reason), after the built-in ones.
    """
    c = F.col
    notional = F.abs(c("quantity") * c("price"))
    checks = [
        (c("killed"), "kill", "kill_switch"), (c("rate") > limits["rate"], "throttle", "rate"), (notional > limits["notional"], "reject", "size"),
        (F.abs(ratio(c("price"), c("ref_price")) - 1) > limits["deviation"], "reject", "fat_finger"), (F.abs(c("position") + c("quantity")) > limits["position"], "reject", "position"),
        (c("daily_pnl") < -limits["daily_loss"], "kill", "daily_loss"), (1 - ratio(c("equity"), c("peak_equity")) > limits["drawdown"], "kill", "drawdown"),
        (ratio(c("gross") + notional, c("equity")) > limits["leverage"], "reject", "leverage"), *extra,
    ]
    decision = reason = None
    for hit, what, why in checks:
        decision = F.when(hit, what) if decision is None else decision.when(hit, what)
        reason = F.when(hit, why) if reason is None else reason.when(hit, why)
    return orders.join(state, by, "left").withColumns({"decision": decision.otherwise("accept"), "reason": reason})


def latched_kill(decided: DataFrame, by: str = "entity", order=("ts", "order_id")) -> DataFrame:
    """Once an entity was killed, all its later orders are."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max((F.col("decision") == "kill").cast("int")).over(w), F.lit(0)) == 1
    return decided.withColumn("decision", F.when(before, "kill").otherwise(F.col("decision")))


def stop_loss_flags(positions: DataFrame, limit: float = 0.05) -> DataFrame:
    move = ratio(F.col("price"), F.col("avg_cost")) - 1
    return positions.withColumn("pnl_pct", F.when(F.col("quantity") >= 0, move).otherwise(-move)).withColumn("stop", F.col("pnl_pct") < -limit)
