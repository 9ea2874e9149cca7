"""Queries of technical and microstructure features."""

from __future__ import annotations

from ..functions.blocks import in_time_blocks
from ..operators import technical as T
from ..sources import views as V
from .registry import query, rounded

KEYS = ["symbol", "ts"]


def _fw(e: str, n: int, agg: str = "avg", order: str = "ts") -> str:
    over = f"over (partition by symbol order by {order} rows {n - 1} preceding)"
    return f"case when count({e}) {over} = {n} then {agg}({e}) {over} end"


def _sel(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


def _pick(df, *cols):
    return rounded(df.select(*KEYS, *cols))


def _tick(df, *cols):
    return rounded(df.select("symbol", "seq", *cols))


_R = f"{V.BARS}, p as (select *, close / nullif(lag(close) over (partition by symbol order by ts), 0) - 1 as r from bars)"


@query(f"with {V.BARS}, x as (select symbol, ts, close / lag(close) over w - 1 as ret_1, ln(close / lag(close) over w) as log_ret_1, close / lag(close, 5) over w - 1 as ret_5, ln(close / lag(close, 5) over w) as log_ret_5 from bars window w as (partition by symbol order by ts)) select symbol, ts, {_sel('ret_1', 'log_ret_1', 'ret_5', 'log_ret_5')} from x")
def wn1_returns(spark, d):
    return _pick(T.returns(V.daily_bars(spark, d), (1, 5)), "ret_1", "log_ret_1", "ret_5", "log_ret_5")


@query(f"with {V.BARS}, x as (select symbol, ts, close / lag(close, 5) over w - 1 as mom_5, 100 * (close / lag(close, 5) over w - 1) as roc_5 from bars window w as (partition by symbol order by ts)) select symbol, ts, {_sel('mom_5', 'roc_5')} from x")
def wn2_momentum(spark, d):
    return _pick(T.momentum(V.daily_bars(spark, d), (5,)), "mom_5", "roc_5")


@query(f"with {V.BARS}, x as (select symbol, ts, close, {_fw('close', 20)} as sma_20, {_fw('close', 50)} as s50, {_fw('close', 100)} as s100 from bars) select symbol, ts, round(sma_20, 6) as sma_20, round(close / sma_20 - 1, 6) as dist_sma_20, coalesce(cast(s50 > s100 as int), 0) as golden_cross from x")
def wn3_sma(spark, d):
    return _pick(T.sma(V.daily_bars(spark, d), (20,), cross=(50, 100)), "sma_20", "dist_sma_20", "golden_cross")


#: Exponential means and the signal of their difference, row by row; each starts at its first value.
_EMA = f"""{V.BARS}, k as (select symbol, ts, close, row_number() over (partition by symbol order by ts) as i from bars),
 f as (select symbol, ts, i, cast(close as double) as e12, cast(close as double) as e26, cast(0 as double) as s from k where i = 1
 union all select symbol, ts, i, e12, e26, 0.2 * (e12 - e26) + 0.8 * s from
 (select k.symbol, k.ts, k.i, 2.0 / 13 * k.close + 11.0 / 13 * f.e12 as e12, 2.0 / 27 * k.close + 25.0 / 27 * f.e26 as e26, f.s from f join k on f.symbol = k.symbol and k.i = f.i + 1))"""


@query(f"with recursive {_EMA} select symbol, ts, round(e12, 6) as ema_12 from f")
def wn4_ema(spark, d):
    return _pick(T.ema(V.daily_bars(spark, d), (12,)), "ema_12")


@query(f"with {_R}, x as (select symbol, ts, {_fw('r', 20, 'stddev_samp')} as vol_20, {_fw('pow(ln(high / low), 2)', 20)} as park from p) select symbol, ts, round(vol_20, 6) as vol_20, round(vol_20 * sqrt(252), 6) as ann_vol_20, round(sqrt(park / (4 * ln(2))), 6) as parkinson_20 from x")
def wn5_volatility(spark, d):
    return _pick(T.volatility(V.daily_bars(spark, d)), "vol_20", "ann_vol_20", "parkinson_20")


@query(f"with {V.BARS}, x as (select symbol, ts, close, {_fw('close', 20)} as m, {_fw('close', 20, 'stddev_samp')} as s from bars) select symbol, ts, round(m + 2 * s, 6) as bb_upper, round(m - 2 * s, 6) as bb_lower, round(4 * s / m, 6) as bb_width, round((close - m + 2 * s) / nullif(4 * s, 0), 6) as bb_pct from x")
def wn6_bollinger(spark, d):
    return _pick(T.bollinger(V.daily_bars(spark, d)), "bb_upper", "bb_lower", "bb_width", "bb_pct")


@query(f"with {V.BARS}, y as (select symbol, ts, coalesce(close - lag(close) over (partition by symbol order by ts), 0) as s from bars), z as (select symbol, ts, {_fw('greatest(s, 0)', 14)} as g, {_fw('greatest(-s, 0)', 14)} as l from y) select symbol, ts, round(case when l = 0 and g > 0 then 100 else 100 - 100 / (1 + g / nullif(l, 0)) end, 6) as rsi from z")
def wn7_rsi(spark, d):
    return _pick(T.rsi(V.daily_bars(spark, d)), "rsi")


@query(f"with recursive {_EMA} select symbol, ts, round(e12 - e26, 6) as macd, round(s, 6) as macd_signal, round(e12 - e26 - s, 6) as macd_hist from f")
def wn8_macd(spark, d):
    return _pick(T.macd(V.daily_bars(spark, d)), "macd", "macd_signal", "macd_hist")


@query(f"with {V.BARS}, y as (select symbol, ts, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr from bars window w as (partition by symbol order by ts)), z as (select symbol, ts, {_fw('tr', 14)} as atr from y) select symbol, ts, round(atr, 6) as atr from z")
def wn9_atr(spark, d):
    return _pick(T.atr(V.daily_bars(spark, d)), "atr")


@query(f"with {V.BARS}, y as (select symbol, ts, close, sum((high + low + close) / 3 * volume) over w / nullif(sum(volume) over w, 0) as vwap from bars window w as (partition by symbol order by ts rows 19 preceding)) select symbol, ts, round(vwap, 6) as vwap, round(close / vwap - 1, 6) as vwap_dev from y")
def wn10_vwap(spark, d):
    return _pick(T.vwap(V.daily_bars(spark, d), 20), "vwap", "vwap_dev")


@query(f"with {V.BARS}, y as (select symbol, ts, volume, {_fw('volume', 20)} as vol_mean_20, {_fw('volume', 20, 'stddev_samp')} as vol_std_20 from bars) select symbol, ts, round(vol_mean_20, 6) as vol_mean_20, round(volume / nullif(vol_mean_20, 0), 6) as vol_ratio_20, round(vol_std_20, 6) as vol_std_20 from y")
def wn11_volume_profile(spark, d):
    return _pick(T.volume_profile(V.daily_bars(spark, d), (20,)), "vol_mean_20", "vol_ratio_20", "vol_std_20")


@query(f"with {V.QUOTES}, y as (select symbol, seq, 10000 * (ask - bid) / nullif(price, 0) as spread_bps, (bid_size - ask_size) / nullif(bid_size + ask_size, 0) as imbalance, price / nullif(lag(price) over (partition by symbol order by ts, seq), 0) - 1 as tick_return, {_fw('price', 20, 'stddev_samp', 'ts, seq')} as price_std_20, {_fw('volume', 50, 'avg', 'ts, seq')} as volume_mean_50 from quotes) select symbol, seq, {_sel('spread_bps', 'imbalance', 'tick_return', 'price_std_20', 'volume_mean_50')} from y")
def wn12_tick_features(spark, d):
    return _tick(T.tick_features(V.quotes(spark, d)), "spread_bps", "imbalance", "tick_return", "price_std_20", "volume_mean_50")


@query(f"with {V.BARS}, y as (select symbol, ts, {_fw('close', 5)} as close_mean_5, {_fw('close', 60, 'stddev_samp')} as close_std_60, {_fw('volume', 20)} as volume_mean_20 from bars) select symbol, ts, {_sel('close_mean_5', 'close_std_60', 'volume_mean_20')} from y")
def wn13_rolling_panel(spark, d):
    return _pick(T.rolling_panel(V.daily_bars(spark, d)), "close_mean_5", "close_std_60", "volume_mean_20")


@query(f"with {V.BARS}, y as (select symbol, ts, close, max(close) over (partition by symbol order by ts rows unbounded preceding) as peak from bars) select symbol, ts, round(peak, 6) as peak, round(close / peak - 1, 6) as drawdown from y")
def wn14_drawdown(spark, d):
    return _pick(T.drawdown(V.daily_bars(spark, d), "close"), "peak", "drawdown")


_N = 20


@query(
    f"""with {V.RETURNS}, z as (select *, lag(ret) over (partition by symbol order by ts) as prv, cast(row_number() over (partition by symbol order by ts) as double) as t from returns),
 y as (select symbol, ts, {_fw('ret', 20, 'stddev_samp')} as roll_std, {_fw('ret', 20)} as roll_mean, case when count(ret) over w = 20 then corr(ret, prv) over w end as autocorr,
 case when count(ret) over w = 20 then regr_slope(ret, t) over w end as slope from z window w as (partition by symbol order by ts rows 19 preceding)),
 s as (select symbol, ts, skewness(ret) over w as k, kurtosis(ret) over w as q, count(ret) over w as n from z window w as (partition by symbol order by ts rows 19 preceding))
 select y.symbol, y.ts, round(roll_std, 6) as roll_std, round(roll_mean, 6) as roll_mean, round(autocorr, 6) as autocorr, round(slope, 6) as slope,
 round(case when n = 20 then k end, 6) as roll_skew, round(case when n = 20 then q end, 6) as roll_kurt from y join s on y.symbol = s.symbol and y.ts = s.ts"""
)
def wn15_regime_features(spark, d):
    r = T.returns(V.daily_bars(spark, d)).withColumnRenamed("ret_1", "ret")
    return _pick(T.regime_features(r), "roll_std", "roll_mean", "autocorr", "slope", "roll_skew", "roll_kurt")


_ALL = f"""with {_R}, x as (
  select symbol, ts, close, r as ret_1, {_fw('close', 20)} as sma_20, {_fw('r', 20, 'stddev_samp')} as vol_20,
    {_fw('close', 20, 'stddev_samp')} as s, {_fw('volume', 20)} as vol_mean_20
  from p
)
select symbol, ts, round(ret_1, 6) as ret_1, round(sma_20, 6) as sma_20, round(vol_20, 6) as vol_20,
  round(sma_20 + 2 * s, 6) as bb_upper, round(vol_mean_20, 6) as vol_mean_20
from x"""


@query(_ALL)
def wn16_technical_all(spark, d):
    return _pick(T.technical_all(V.daily_bars(spark, d)), "ret_1", "sma_20", "vol_20", "bb_upper", "vol_mean_20")


@query(_ALL)
def wn16_technical_blocks(spark, d):
    """The same rows from overlapping blocks of at most 500 rows of a symbol."""
    return _pick(T.technical_all(V.daily_bars(spark, d), block_rows=500), "ret_1", "sma_20", "vol_20", "bb_upper", "vol_mean_20")


@query(
    f"""with {V.BARS}, y as (
  select symbol, ts, close, sum((high + low + close) / 3 * volume) over w / nullif(sum(volume) over w, 0) as vwap
  from bars window w as (partition by symbol order by ts)
)
select symbol, ts, round(vwap, 6) as vwap, round(close / nullif(vwap, 0) - 1, 6) as vwap_dev from y"""
)
def wn10_vwap_buckets(spark, d):
    """The cumulative VWAP from sums by time bucket, carried forward."""
    return _pick(T.vwap_of_buckets(V.daily_bars(spark, d), block_rows=500), "vwap", "vwap_dev")


@query(f"with {V.BARS}, y as (select symbol, ts, lag(close, 1) over w as close_lag_1, lag(volume, 3) over w as volume_lag_3 from bars window w as (partition by symbol order by ts)) select symbol, ts, {_sel('close_lag_1', 'volume_lag_3')} from y")
def wn17_lags(spark, d):
    return _pick(T.create_lags(V.daily_bars(spark, d), ["close", "volume"], (1, 3)), "close_lag_1", "volume_lag_3")


@query(f"with {V.BARS} select symbol, ts, round(lead(close, 5) over (partition by symbol order by ts) / close - 1, 6) as label from bars")
def wn18_forward_label(spark, d):
    return _pick(T.forward_label(V.daily_bars(spark, d)), "label")


@query(f"with {V.BARS}, y as (select symbol, ts, close, avg(close) over w as m, stddev_pop(close) over w as s, count(close) over w as n from bars window w as (partition by symbol order by ts rows between 19 preceding and 1 preceding)) select symbol, ts, round(case when n = 19 then case when s = 0 then 0 else (close - m) / nullif(s, 0) end end, 6) as zscore from y")
def wn19_zscore_signal(spark, d):
    return _pick(T.rolling_zscore_signal(V.daily_bars(spark, d)), "zscore")


@query(
    f"""with {V.TICKS}, r as (select symbol, seq, ts, price / nullif(lag(price) over (partition by symbol order by ts, seq), 0) - 1 as r, row_number() over (partition by symbol order by ts, seq) as i from ticks),
 j as (select a.symbol, a.seq, a.i, b.r, pow(1 - 2.0 / 21, a.i - b.i) as w from r a join r b on a.symbol = b.symbol and b.i between a.i - 19 and a.i where b.r is not null),
 m as (select symbol, seq, avg(r) as m, count(*) as n from j group by 1, 2),
 v as (select j.symbol, j.seq, sqrt(sum(w * (r - m) * (r - m)) / sum(w)) as v, any_value(n) as n from j join m on j.symbol = m.symbol and j.seq = m.seq group by 1, 2)
 select r.symbol, r.seq, round(case when n > 1 then v end, 6) as ewm_vol from r left join v on r.symbol = v.symbol and r.seq = v.seq"""
)
def wn20_ewm_volatility(spark, d):
    return _tick(T.ewm_quote_volatility(V.ticks(spark, d)), "ewm_vol")


@query(f"with {V.QUOTES} select symbol, seq, round(avg((bid_size - ask_size) / nullif(bid_size + ask_size, 0)) over (partition by symbol order by ts, seq rows 9 preceding), 6) as ofi from quotes")
def ms1_order_flow_imbalance(spark, d):
    return _tick(T.order_flow_imbalance(V.quotes(spark, d)), "ofi")


@query(
    f"""with {V.QUOTES}, y as (select *, (bid + ask) / 2 - lag((bid + ask) / 2) over w as step, bid_size - lag(bid_size) over w as db, ask_size - lag(ask_size) over w as da from quotes window w as (partition by symbol order by ts, seq)),
 z as (select *, case when step >= 0 then db else 0 end - case when step <= 0 then da else 0 end as v from y) select symbol, seq, round(sum(v) over (partition by symbol order by ts, seq rows 9 preceding), 6) as voi from z"""
)
def ms2_volume_order_imbalance(spark, d):
    return _tick(T.volume_order_imbalance(V.quotes(spark, d)), "voi")


@query(f"with {V.QUOTES} select symbol, seq, round(ask - bid, 6) as quoted, round(10000 * (ask - bid) / nullif((bid + ask) / 2, 0), 6) as quoted_bps, round(2 * abs(price - (bid + ask) / 2), 6) as effective, round(10000 * 2 * abs(price - (bid + ask) / 2) / nullif((bid + ask) / 2, 0), 6) as effective_bps from quotes")
def ms3_spreads(spark, d):
    return _tick(T.spreads(V.quotes(spark, d)), "quoted", "quoted_bps", "effective", "effective_bps")


@query(f"with {V.TICKS} select symbol, seq, round(0.04 / (5 * size + 15), 6) as bid_slope, round(0.04 / (10 * size + 15), 6) as ask_slope from ticks")
def ms4_book_slope(spark, d):
    return _tick(T.book_slope(T.book_from_ticks(V.ticks(spark, d))), "bid_slope", "ask_slope")


@query(f"with {V.TICKS} select symbol, seq, round(3 * size + 6, 6) as bid_depth, round(6 * size + 6, 6) as ask_depth from ticks")
def ms5_book_depth(spark, d):
    return _tick(T.book_depth(T.book_from_ticks(V.ticks(spark, d)), 3), "bid_depth", "ask_depth")


@query(f"with {V.TICKS} select a.symbol, a.seq, count(*) as trades from ticks a join ticks b on a.symbol = b.symbol and b.ts > a.ts - interval 1 day and b.ts <= a.ts group by 1, 2")
def ms6_trade_intensity(spark, d):
    return T.trade_intensity(V.ticks(spark, d), 86400).select("symbol", "seq", "trades")


@query(f"with {V.QUOTES}, y as (select *, (price - lag(price) over (partition by symbol order by ts, seq)) / nullif(sqrt(volume), 0) as i from quotes), z as (select symbol, seq, {_fw('i', 10, 'avg', 'ts, seq')} as impact from y) select symbol, seq, round(impact, 6) as impact from z")
def ms7_price_impact(spark, d):
    return _tick(T.price_impact(V.quotes(spark, d)), "impact")


@query(f"with {V.TICKS}, y as (select *, price / nullif(lag(price) over (partition by symbol order by ts, seq), 0) - 1 as r from ticks), z as (select symbol, seq, {_fw('r', 20, 'stddev_samp', 'ts, seq')} * sqrt(252 * 6.5 * 3600) as v from y) select symbol, seq, round(v, 4) as realized_vol from z")
def ms8_realized_volatility(spark, d):
    return rounded(T.realized_volatility(V.ticks(spark, d)).select("symbol", "seq", "realized_vol"), 4)


@query(f"with {V.TICKS} select symbol, seq, round(price - 0.01, 6) as best_bid, round(price + 0.01, 6) as best_ask, round(price, 6) as mid, round(0.02, 6) as spread from ticks")
def ms9_best_quotes(spark, d):
    return _tick(T.best_quotes(T.book_from_ticks(V.ticks(spark, d))), "best_bid", "best_ask", "mid", "spread")


_TRAILING = ("n", "price_mean", "price_std", "price_min", "price_max", "size_sum", "size_mean", "vwap", "imbalance")
_TRAILING_SQL = f"""with {V.TICKS}, y as (
  select symbol, seq, avg(price) over w as price_mean, coalesce(stddev_samp(price) over w, 0) as price_std, min(price) over w as price_min,
    max(price) over w as price_max, count(*) over w as n, sum(size) over w as size_sum, avg(size) over w as size_mean,
    sum(price * size) over w / nullif(sum(size) over w, 0) as vwap,
    (sum(case when side = 'B' then size else 0 end) over w - sum(case when side = 'A' then size else 0 end) over w)
      / nullif(sum(case when side in ('A', 'B') then size else 0 end) over w, 0) as imbalance
  from ticks window w as (partition by symbol order by ts range interval 1 day preceding)
)
select symbol, seq, n, {_sel(*_TRAILING[1:])} from y"""


@query(_TRAILING_SQL)
def ms10_trailing_blocks(spark, d):
    """The same rows as ms10_trailing_features, from time buckets that overlap by the frame."""
    build = lambda df, by: T.trailing_features(df, 86400, by)
    return _tick(in_time_blocks(V.ticks(spark, d), build, ["symbol"], "ts", 86400, block_rows=5), *_TRAILING)


@query(_TRAILING_SQL)
def ms10_trailing_features(spark, d):
    return _tick(T.trailing_features(V.ticks(spark, d), 86400), *_TRAILING)
