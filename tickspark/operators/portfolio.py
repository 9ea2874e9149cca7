"""Portfolio analytics on long return tables (date, symbol, ret): risk, performance, covariance, regimes, statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import largest_key
from ..functions.quantiles import exact_quantiles
from ..functions.scratch import stored
from ..functions.windows import correlation, ratio
from .matrices import correlation_pairs, lag_tests
from .pairs import pair_sums, panel_rows, residual_steps, weighted_covariances, weighted_variances

YEAR = 252


def portfolio_returns(returns: DataFrame, weights: DataFrame, by=()) -> DataFrame:
    """Weighted return of each date (and portfolio)."""
    return returns.join(weights, "symbol").groupBy(*by, "ts").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))


def portfolio_var_cvar(port: DataFrame, conf: float = 0.95, by=("portfolio",), keep: bool = True) -> DataFrame:
    """Historical value at risk and the mean loss beyond it, both positive; keep=False is for returns that are stored already."""
    port = stored(port.select(*by, "ret"), "returns") if keep else port
    cut = exact_quantiles(port, "ret", {"_q": 1 - conf}, list(by), keep=False)
    tail = port.join(cut, list(by)).filter("ret <= _q")
    return tail.groupBy(*by).agg(F.abs(F.first("_q")).alias("var"), F.abs(F.avg("ret")).alias("cvar"))


def compounded(df: DataFrame, by, ret: str = "ret", order=("ts",)) -> DataFrame:
    """Adds equity (compounded), its running peak and the drawdown."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col(ret))).over(w)))
    return out.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def risk_metrics(port: DataFrame, by=("portfolio",)) -> DataFrame:
    """Annualised volatility and downside deviation, VaR and CVaR at 95 %, largest drawdown (negative)."""
    down = F.when(F.col("ret") < 0, F.col("ret"))
    port = stored(port, "returns")
    base = compounded(port, by).groupBy(*by).agg(
        (F.stddev_samp("ret") * math.sqrt(YEAR)).alias("volatility"), (F.stddev_samp(down) * math.sqrt(YEAR)).alias("downside"), F.min("drawdown").alias("max_drawdown")
    )
    return base.join(portfolio_var_cvar(port, 0.95, by, keep=False), list(by))


def performance_metrics(equity: DataFrame, rf: float = 0.02, by=("portfolio",), ddof: int = 1) -> DataFrame:
    """Total and annual return, Sharpe, Sortino, largest drawdown (positive), Calmar, from (ts, equity)."""
    w = Window.partitionBy(*by).orderBy("ts")
    df = equity.withColumn("_r", ratio(F.col("equity"), F.lag("equity").over(w)) - 1)
    df = df.withColumn("_p", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    excess, dev = F.col("_r") - rf / YEAR, F.stddev_samp if ddof else F.stddev_pop
    out = df.groupBy(*by).agg(
        (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("total_return"), F.count("_r").alias("n"),
        (math.sqrt(YEAR) * ratio(F.avg(excess), dev(excess))).alias("sharpe"), (math.sqrt(YEAR) * ratio(F.avg(excess), dev(F.when(excess < 0, excess)))).alias("sortino"),
        F.max(1 - F.col("equity") / F.col("_p")).alias("max_drawdown"),
    )
    out = out.withColumn("annual_return", F.pow(1 + F.col("total_return"), F.lit(float(YEAR)) / F.nullif(F.col("n"), F.lit(0))) - 1)
    return out.withColumn("calmar", ratio(F.col("annual_return"), F.col("max_drawdown"))).drop("n")


def trade_statistics(trades: DataFrame, by=("portfolio",), order=("ts",)) -> DataFrame:
    """Win rate, profit factor (null and flagged without a loss), averages, longest streaks; a pnl of 0 counts as a loss."""
    w = Window.partitionBy(*by).orderBy(*order)
    won = F.col("pnl") > 0
    runs = trades.withColumn("_w", won).withColumn("_n", F.when(F.lag("_w").over(w) == F.col("_w"), 0).otherwise(1)).withColumn("_run", F.sum("_n").over(w))
    streak = runs.groupBy(*by, "_run", "_w").agg(F.count("*").alias("_len")).groupBy(*by)
    streak = streak.agg(F.coalesce(F.max(F.when(F.col("_w"), F.col("_len"))), F.lit(0)).alias("win_streak"), F.coalesce(F.max(F.when(~F.col("_w"), F.col("_len"))), F.lit(0)).alias("loss_streak"))
    gain, loss = F.sum(F.when(won, F.col("pnl"))), F.abs(F.sum(F.when(~won, F.col("pnl"))))
    out = trades.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(won.cast("double")).alias("win_rate"), ratio(gain, loss).alias("profit_factor"), (F.coalesce(loss, F.lit(0.0)) == 0).alias("no_losses"),
        F.avg(F.when(won, F.col("pnl"))).alias("avg_win"), F.avg(F.when(~won, F.col("pnl"))).alias("avg_loss"),
    )
    return out.join(streak, list(by))


def aggregate_sweep(parts: DataFrame) -> DataFrame:
    """Per run: pnl, trades, Sharpe and largest drawdown from daily returns summed over partitions."""
    daily = parts.groupBy("run", "ts").agg(F.sum("ret").alias("ret"), F.sum("pnl").alias("pnl"), F.sum("trades").alias("trades"))
    return compounded(daily, ("run",)).groupBy("run").agg(
        F.sum("pnl").alias("pnl"), F.sum("trades").alias("trades"), (math.sqrt(YEAR) * ratio(F.avg("ret"), F.stddev_samp("ret"))).alias("sharpe"), F.min("drawdown").alias("max_drawdown")
    )


def rank_runs(runs: DataFrame, metric: str = "sharpe") -> DataFrame:
    """Runs by falling metric; nulls last, ties by run."""
    return runs.orderBy(F.col(metric).desc_nulls_last(), "run")


def regime_statistics(df: DataFrame) -> DataFrame:
    """Per symbol and regime: rows, share, mean, deviation, their ratio, largest drawdown of that regime's compounded returns."""
    n = df.groupBy("symbol").agg(F.count("*").alias("_n"))
    out = compounded(df, ("symbol", "regime")).groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("vol"), F.min("drawdown").alias("max_drawdown"))
    return out.join(n, "symbol").withColumns({"share": F.col("n") / F.col("_n"), "mean_over_vol": ratio(F.col("mean"), F.col("vol"))}).drop("_n")


def transition_matrix(df: DataFrame) -> DataFrame:
    nxt = df.withColumn("to", F.lead("regime").over(Window.partitionBy("symbol").orderBy("ts"))).filter("to is not null")
    counts = nxt.groupBy(F.col("regime").alias("from"), "to").agg(F.count("*").alias("n"))
    total = counts.groupBy("from").agg(F.sum("n").alias("_t"))
    return counts.join(total, "from").select("from", "to", (F.col("n") / F.col("_t")).alias("p"))


def _long(row: DataFrame, names: list[str], pairs: list[tuple[str, str]], value: str) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1]), F.col(f"{a}|{b}").alias(value)) for a, b in pairs)))
    return row.select(cells.alias("x")).select("x.*")


#: Columns from which on correlations come from tiles instead of one expression for each pair.
WIDE = 24


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feat_a, feat_b, corr) of all pairs a < b in the given order, from one pass; wide tables by tiles of products (see correlation_pairs)."""
    if len(cols) >= WIDE:
        return correlation_pairs(df, cols).select("feat_a", "feat_b", "corr")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    return _long(df.agg(*(correlation(a, b).alias(f"{a}|{b}") for a, b in pairs)), ["feat_a", "feat_b"], pairs, "corr")


def feature_graph(df: DataFrame, cols: list[str], threshold: float) -> DataFrame:
    return correlation_matrix(df, cols).filter(F.abs("corr") > threshold).withColumn("weight", F.abs("corr")).drop("corr")


#: Symbols that a block has at the fullest time.
BLOCK_SYMBOLS = 128


def _at_common_times(returns: DataFrame, value: str, order: str, blocks: int | None = None) -> DataFrame:
    """(ts, a, b, x, y) for symbols a, b in the given order at common times; symbols are dealt into blocks, so that a time is shared by blocks^2 tasks.

    Without a number of blocks it follows from the symbols at the fullest time.
    """
    blocks = blocks or max(1, -(-largest_key(returns, ["ts"]) // BLOCK_SYMBOLS))
    block = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    every = F.explode(F.array(*map(F.lit, range(blocks))))
    base = returns.select("ts", "symbol", F.col(value).alias("_v"), block.alias("_own")).withColumn("_other", every)
    a = base.select("ts", F.col("_own").alias("_p"), F.col("_other").alias("_q"), F.col("symbol").alias("a"), F.col("_v").alias("x"))
    b = base.select("ts", F.col("_other").alias("_p"), F.col("_own").alias("_q"), F.col("symbol").alias("b"), F.col("_v").alias("y"))
    return a.join(b, ["ts", "_p", "_q"]).filter(order).select("ts", "a", "b", "x", "y")


def pair_panel(returns: DataFrame, value: str = "ret", least: int = 30, blocks: int | None = None) -> DataFrame:
    """Rows of all symbol pairs a < b at common times; pairs with fewer rows go.

    Pairs of blocks of symbols make their rows in one task each; series too long for that are joined by time.
    """
    rows = panel_rows(returns, value, least, blocks)
    if rows is not None:
        return rows
    both = _at_common_times(returns, value, "a < b", blocks)
    return both.withColumn("_n", F.count("*").over(Window.partitionBy("a", "b"))).filter(F.col("_n") >= least).select("a", "b", "ts", "x", "y")


def _means(returns: DataFrame, periods: int) -> DataFrame:
    return returns.groupBy("symbol").agg((F.avg("ret") * periods).alias("mu"))


def return_moments(returns: DataFrame, periods: int = YEAR, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(mean by symbol, covariance by a <= b), annualised; sums of pairs of symbols are made where their blocks meet."""
    mean = _means(returns, periods)
    sums = pair_sums(returns, "ret", True, blocks, spread=False)
    return mean, sums.select("a", "b", (F.col("cov") * F.col("m") / F.nullif(F.col("m") - 1, F.lit(0)) * periods).alias("cov"), "n")


def portfolio_stats(weights: DataFrame, mu: DataFrame, cov: DataFrame) -> DataFrame:
    """Per portfolio: return, volatility and their ratio, for covariances given for a <= b."""
    wa = weights.select("portfolio", F.col("symbol").alias("a"), F.col("weight").alias("wa"))
    wb = weights.select("portfolio", F.col("symbol").alias("b"), F.col("weight").alias("wb"))
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    var = wa.join(cov, "a").join(wb, ["portfolio", "b"]).groupBy("portfolio").agg(F.sum(twice * F.col("wa") * F.col("wb") * F.col("cov")).alias("var"))
    return _stats(weights, mu, var)


def portfolio_stats_of_returns(returns: DataFrame, weights: DataFrame, periods: int = YEAR, blocks: int | None = None) -> DataFrame:
    """portfolio_stats with the moments of the returns (read several times: stored ones); covariances are summed where they are made."""
    var = weighted_variances(returns, "ret", weights, blocks)
    if var is None:
        return portfolio_stats(weights, *return_moments(returns, periods, blocks))
    return _stats(weights, _means(returns, periods), var.withColumn("var", F.col("var") * periods))


def _stats(weights: DataFrame, mu: DataFrame, var: DataFrame) -> DataFrame:
    ret = weights.join(mu, "symbol").groupBy("portfolio").agg(F.sum(F.col("weight") * F.col("mu")).alias("ret"))
    return ret.join(var, "portfolio").select("portfolio", "ret", F.sqrt(F.greatest("var", F.lit(0.0))).alias("vol")).withColumn("ratio", ratio(F.col("ret"), F.col("vol")))


def vol_target(stats: DataFrame, target: float) -> DataFrame:
    return stats.withColumn("scale", ratio(F.lit(target), F.col("vol")))


def corr_distance(returns: DataFrame, least: int = 3) -> DataFrame:
    """sqrt((1 - corr) / 2) of each symbol pair."""
    pairs = pair_sums(returns, "ret", least=least)
    corr = F.col("cov") / F.nullif(F.sqrt("vx") * F.sqrt("vy"), F.lit(0.0))
    return pairs.select("a", "b", F.sqrt(F.greatest((1 - corr) / 2, F.lit(0.0))).alias("distance"))


def market_implied_returns(caps: DataFrame, cov: DataFrame, aversion: float = 2.5) -> DataFrame:
    """lambda Sigma w with capitalisation weights, for covariances given for a <= b."""
    w = _cap_weights(caps)
    other = F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    full = cov.select("cov", F.explode(F.array_compact(F.array(F.struct("a", "b"), other))).alias("p")).select("p.a", "p.b", "cov")
    return full.join(w.withColumnRenamed("symbol", "b"), "b").groupBy(F.col("a").alias("symbol")).agg((aversion * F.sum(F.col("cov") * F.col("w"))).alias("implied"))


def market_implied_of_returns(returns: DataFrame, caps: DataFrame, aversion: float = 2.5, periods: int = YEAR, blocks: int | None = None) -> DataFrame:
    """market_implied_returns with the covariances of the returns, which are summed where they are made."""
    total = weighted_covariances(returns, "ret", _cap_weights(caps), blocks)
    if total is None:
        return market_implied_returns(caps, return_moments(returns, periods, blocks)[1], aversion)
    return total.select("symbol", (aversion * periods * F.col("total")).alias("implied"))


def _cap_weights(caps: DataFrame) -> DataFrame:
    total = caps.agg(F.sum("cap").alias("_t"))
    return caps.crossJoin(F.broadcast(total)).select("symbol", (F.col("cap") / F.col("_t")).alias("w"))  # one row


# ---- dependence between features


def _bin(df: DataFrame, cols: list[str], bins: int) -> DataFrame:
    """Equal-width bins 1..bins of the columns."""
    ends = df.agg(*(f(c).alias(f"_{c}_{k}") for c in cols for k, f in (("a", F.min), ("b", F.max))))
    out = df.crossJoin(F.broadcast(ends))  # one row
    place = lambda c: F.least(F.floor((F.col(c) - F.col(f"_{c}_a")) / F.nullif(F.col(f"_{c}_b") - F.col(f"_{c}_a"), F.lit(0.0)) * bins) + 1, F.lit(bins))
    return out.withColumns({f"{c}_bin": F.coalesce(place(c), F.when(F.col(c).isNotNull(), F.lit(1))) for c in cols})


def binned_mutual_information(df: DataFrame, target: str, cols: list[str], bins: int = 10) -> DataFrame:
    """(feature, mi): plug-in estimate in nats over equal-width bins."""
    long = _bin(df, [target, *cols], bins).select(F.col(f"{target}_bin").alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(f"{c}_bin").alias("b")) for c in cols))).alias("z"))
    joint = long.filter("y is not null and z.b is not null").groupBy(F.col("z.f").alias("feature"), F.col("z.b").alias("x"), "y").agg(F.count("*").alias("n"))
    wx, wy, wf = Window.partitionBy("feature", "x"), Window.partitionBy("feature", "y"), Window.partitionBy("feature")
    total = F.sum("n").over(wf)
    term = F.col("n") / total * F.ln(F.col("n") * total / (F.sum("n").over(wx) * F.sum("n").over(wy)))
    return joint.withColumn("_t", term).groupBy("feature").agg(F.sum("_t").alias("mi"))


def transfer_entropy(df: DataFrame, x: str, y: str, lag: int = 1, bins: int = 10, by: str = "symbol", order=("ts",)) -> DataFrame:
    """One row: plug-in transfer entropy from x to y in bits, at least 0, and 0 under ten rows."""
    w = Window.partitionBy(by).orderBy(*order)
    b = _bin(df, [x, y], bins).select(F.col(f"{y}_bin").alias("a"), F.lag(f"{y}_bin", lag).over(w).alias("b"), F.lag(f"{x}_bin", lag).over(w).alias("c")).dropna()
    joint = b.groupBy("a", "b", "c").agg(F.count("*").alias("n"))
    n = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    term = F.col("n") * F.log2(F.col("n") * n("b") / (n("b", "c") * n("a", "b")))
    out = joint.withColumn("_t", term).agg(F.sum("n").alias("n"), (F.sum("_t") / F.sum("n")).alias("te"))
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= 10, F.greatest("te", F.lit(0.0))).otherwise(0.0).alias("te"))


def lag_correlations(df: DataFrame, target: str, cols: list[str], max_lag: int, by: str = "symbol", order=("ts",)) -> DataFrame:
    """(feature, lag, abs_corr, best): absolute correlation of each lagged feature with the target."""
    w = Window.partitionBy(by).orderBy(*order)
    lagged = df.select(target, *(F.lag(c, k).over(w).alias(f"{c}|{k}") for c in cols for k in range(1, max_lag + 1)))
    pairs = [(c, k) for c in cols for k in range(1, max_lag + 1)]
    row = lagged.agg(*(F.abs(correlation(f"`{c}|{k}`", target)).alias(f"{c}|{k}") for c, k in pairs))
    out = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(k).alias("lag"), F.col(f"`{c}|{k}`").alias("abs_corr")) for c, k in pairs))).alias("x")).select("x.*")
    best = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("abs_corr"), "lag")) == 1
    return out.withColumn("best", best)


def interaction_strength(df: DataFrame, f1: str, f2: str, target: str) -> DataFrame:
    a, b, c = F.abs(correlation(f1, target)), F.abs(correlation(f2, target)), F.abs(correlation(F.col(f1) * F.col(f2), F.col(target)))
    return df.agg(F.greatest(F.lit(0.0), c - F.greatest(a, b)).alias("strength"))


def find_confounders(df: DataFrame, treatment: str, outcome: str, cols: list[str], threshold: float = 0.3) -> DataFrame:
    row = df.agg(*(correlation(c, k).alias(f"{c}|{k}") for c in cols for k in (treatment, outcome)))
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}|{treatment}").alias("with_treatment"), F.col(f"{c}|{outcome}").alias("with_outcome")) for c in cols))
    out = row.select(F.explode(cells).alias("x")).select("x.*")
    return out.filter((F.abs("with_treatment") > threshold) & (F.abs("with_outcome") > threshold))


def cointegration_of_series(series: DataFrame, value: str = "close", least: int = 30, level: float = -3.34, blocks: int | None = None) -> DataFrame:
    """cointegration_scan of the pair_panel of (symbol, ts, value), whose rows are made and summed where the blocks of symbols meet."""
    sums = residual_steps(series, value, least, blocks)
    return cointegration_scan(pair_panel(series, value, least, blocks), level) if sums is None else _dickey_fuller(sums, level)


def cointegration_scan(panel: DataFrame, level: float = -3.34) -> DataFrame:
    """Per pair: hedge ratio of a on b, intercept, lag-0 Dickey-Fuller t of the residuals, and whether it is under the level.

    The default level is the published 5 % critical value for two series.
    """
    fit = panel.groupBy("a", "b").agg(F.regr_slope("x", "y").alias("hedge"), F.regr_intercept("x", "y").alias("intercept"))
    w = Window.partitionBy("a", "b").orderBy("ts")
    res = panel.join(fit, ["a", "b"]).withColumn("_e", F.col("x") - F.col("intercept") - F.col("hedge") * F.col("y"))
    res = res.withColumn("_l", F.lag("_e").over(w)).filter("_l is not null").withColumn("_d", F.col("_e") - F.col("_l"))
    g = res.groupBy("a", "b", "hedge", "intercept").agg(F.sum(F.col("_d") * F.col("_l")).alias("_xy"), F.sum(F.col("_l") ** 2).alias("_xx"), F.sum(F.col("_d") ** 2).alias("_yy"), F.count("*").alias("n"))
    return _dickey_fuller(g, level)


def _dickey_fuller(g: DataFrame, level: float) -> DataFrame:
    rho = ratio(F.col("_xy"), F.col("_xx"))
    s2 = (F.col("_yy") - rho * F.col("_xy")) / F.nullif(F.col("n") - 1, F.lit(0))
    t = rho / F.nullif(F.sqrt(F.greatest(s2 / F.nullif(F.col("_xx"), F.lit(0.0)), F.lit(0.0))), F.lit(0.0))
    return g.select("a", "b", "hedge", "intercept", "n", t.alias("t")).withColumn("cointegrated", F.col("t") < level)


def _beta_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f) for an F distribution, by the continued fraction of the incomplete beta function."""
    if not f > 0:
        return 1.0
    a, b, x = d2 / 2, d1 / 2, d2 / (d2 + d1 * f)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cf(b, a, 1 - x)
    return _beta_cf(a, b, x)


def _beta_cf(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300))) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            out *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return front * out


def granger(df: DataFrame, target: str, cols: list[str], max_lag: int = 3, by: str = "symbol", order=("ts",)) -> DataFrame:
    """(symbol, feature, best_lag, p): smallest p of the F-tests (see lag_tests) of adding the feature's lags to the target's own."""
    tests = lag_tests(df, target, cols, max_lag, by, order)

    def tails(batches):
        for t in batches:
            p = [None if f != f else _beta_tail(f, k, int(n) - 2 * k - 1) for f, k, n in zip(t["f"].astype(float), t["lag"], t["n"])]
            yield t[[by, "feature", "lag"]].assign(p=pd.Series(p, t.index, dtype=float))

    rated = tests.mapInPandas(tails, f"`{by}` {dict(df.dtypes)[by]}, feature string, lag int, p double")
    # a test that could not be made is NaN in pandas
    rated = rated.withColumn("p", F.nanvl("p", F.lit(None)))
    return rated.groupBy(by, "feature").agg(F.min_by("lag", F.when(F.col("p").isNotNull(), F.struct("p", "lag"))).alias("best_lag"), F.min("p").alias("p"))


# ---- whole-series transforms


def frac_diff_weights(d: float, threshold: float) -> np.ndarray:
    w, k = [1.0], 1
    while abs(w[-1]) >= threshold:
        w.append(-w[-1] * (d - k + 1) / k)
        k += 1
    return np.array(w[:-1])


def frac_diff(df: DataFrame, col: str = "close", d: float = 0.5, threshold: float = 1e-5, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Fractional difference with fixed weights, a sum over a window of as many rows; the first output is at row len(weights) (one late).

    A null value makes the outputs null that it weighs in.
    """
    weights = frac_diff_weights(d, threshold)
    rows = Window.partitionBy(by).orderBy(order)
    past = F.collect_list(F.coalesce(F.col(col).cast("double"), F.lit(float("nan")))).over(rows.rowsBetween(1 - len(weights), 0))
    # the oldest value comes first
    total = F.aggregate(F.zip_with(past, F.array(*map(F.lit, weights[::-1].tolist())), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    full = (F.row_number().over(rows) > len(weights)) & ~F.isnan(total)
    return df.select(by, order, F.when(full, total).alias("frac"))


def hurst(df: DataFrame, col: str = "close", max_lag: int = 20, by: str = "symbol", order=("ts",)) -> DataFrame:
    """Slope of ln deviation of k-step differences on ln k, k = 2 .. max_lag - 1."""
    w = Window.partitionBy(by).orderBy(*order)
    lags = range(2, max_lag)
    steps = df.select(by, *((F.col(col) - F.lag(col, k).over(w)).alias(f"d{k}") for k in lags))
    wide = steps.groupBy(by).agg(*(F.stddev_pop(f"d{k}").alias(f"s{k}") for k in lags))
    points = wide.select(by, F.explode(F.array(*(F.struct(F.lit(math.log(k)).alias("x"), F.ln(F.when(F.col(f"s{k}") > 0, F.col(f"s{k}"))).alias("y")) for k in lags))).alias("p"))
    return points.groupBy(by).agg(F.regr_slope("p.y", "p.x").alias("hurst"))


def dfa(df: DataFrame, col: str = "ret", scales=(4, 8, 16, 32), by: str = "symbol", order=("ts",)) -> DataFrame:
    """Detrended fluctuation: slope of ln F on ln scale, F the RMS of linear residuals over whole segments."""
    w = Window.partitionBy(by).orderBy(*order)
    mean = df.groupBy(by).agg(F.avg(col).alias("_m"), F.count(col).alias("_n"))
    x = df.filter(F.col(col).isNotNull()).join(mean, by).withColumn("_y", F.sum(F.col(col) - F.col("_m")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_i", F.row_number().over(w) - 1).select(by, "_y", "_i", "_n", F.explode(F.array(*map(F.lit, scales))).alias("scale"))
    x = x.withColumn("_g", F.floor(F.col("_i") / F.col("scale"))).filter((F.col("_g") + 1) * F.col("scale") <= F.col("_n"))
    seg = x.groupBy(by, "scale", "_g").agg((F.regr_syy("_y", F.col("_i").cast("double")) - F.pow(F.regr_sxy("_y", F.col("_i").cast("double")), 2) / F.regr_sxx("_y", F.col("_i").cast("double"))).alias("_r"))
    f = seg.groupBy(by, "scale").agg(F.sqrt(F.avg(F.greatest(F.col("_r") / F.col("scale"), F.lit(0.0)))).alias("_f"))
    return f.filter("_f > 0").groupBy(by).agg(F.regr_slope(F.ln("_f"), F.ln(F.col("scale").cast("double"))).alias("dfa"))
