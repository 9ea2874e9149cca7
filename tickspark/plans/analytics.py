"""Queries of fills, orders, positions, portfolio analytics, statistics and series transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import stored
from ..operators import ledger as L
from ..operators import portfolio as P
from ..operators import spectral as S
from ..operators import technical as T
from ..sources import views as V
from .registry import query, rounded


def _returns(spark, d):
    return T.returns(V.daily_bars(spark, d)).select("symbol", "ts", F.col("ret_1").alias("ret")).filter("ret is not null")


_RET = f"{V.RETURNS}, r as (select * from returns where ret is not null)"
_PANEL = f"{_RET}, pan as (select x.symbol as a, y.symbol as b, x.ts, x.ret as x, y.ret as y from r x join r y on x.ts = y.ts and x.symbol < y.symbol)"


def _fills(spark, d):
    return V.fills_internal(spark, d), V.fills_exchange(spark, d)


_KEY = "order_id, symbol, side, venue"


def _result(a: str, b: str) -> str:
    """SQL: the first check that two fills fail."""
    return f"""case when abs({a}.q - {b}.q) > 0.001 then 'quantity' when abs({a}.p - {b}.p) > 0.01 then 'price'
    when abs({a}.t - {b}.t) / 1000 > 1000 then 'timestamp_drift' else 'matched' end"""


#: Fills of both sides in the order of arrival; each step has the lists of fills that wait and what the newest one was compared with.
_MATCH = f"""{V.FILLS},
ev as (
  select {_KEY}, theirs, {{'id': fill_id, 'q': quantity, 'p': price, 't': epoch_us(ts)}} as f,
    row_number() over (partition by {_KEY} order by ts, theirs, fill_id) as r
  from (select *, 0 as theirs from internal union all by name select *, 1 as theirs from exchange)
),
st as (
  select {_KEY}, r, theirs, [f for x in [1] if theirs = 0] as wi, [f for x in [1] if theirs = 1] as wx,
    cast(null as varchar) as internal_id, cast(null as varchar) as exchange_id, cast(null as varchar) as result
  from ev where r = 1
  union all
  select {_KEY}, r, theirs,
    case when result = 'matched' then case when theirs = 0 then wi else wi[2:] end when theirs = 0 then list_append(wi, f) else wi end,
    case when result = 'matched' then case when theirs = 1 then wx else wx[2:] end when theirs = 1 then list_append(wx, f) else wx end,
    case when result is not null then case when theirs = 0 then f.id else wi[1].id end end,
    case when result is not null then case when theirs = 1 then f.id else wx[1].id end end, result
  from (
    select {', '.join(f'e.{c}' for c in _KEY.split(', '))}, e.r, e.theirs, e.f, s.wi, s.wx,
      case when e.theirs = 0 and len(s.wx) > 0 then {_result('e.f', 's.wx[1]')} when e.theirs = 1 and len(s.wi) > 0 then {_result('e.f', 's.wi[1]')} end as result
    from st s join ev e on {' and '.join(f's.{c} = e.{c}' for c in _KEY.split(', '))} and e.r = s.r + 1
  )
),
m as (select {_KEY}, internal_id, exchange_id, result from st where result is not null)"""


@query(f"with recursive {_MATCH} select internal_id, exchange_id, result from m")
def jn6_match_fills(spark, d):
    return L.match_fills(*_fills(spark, d))


@query(f"with recursive {_MATCH} select internal_id, exchange_id, result from m where (order_id, symbol, side, venue) in (select (order_id, symbol, side, venue) from internal group by order_id, symbol, side, venue having count(*) > 1)")
def jn6_match_fills_greedy(spark, d):
    """The keys with several internal fills, which only the stream matches."""
    ours, theirs = _fills(spark, d)
    several = ours.groupBy(*L.MATCH_KEY).count().filter("count > 1").drop("count")
    return L.match_fills(ours.join(several, L.MATCH_KEY, "left_semi"), theirs)


@query(
    f"""with recursive {_MATCH}, ok as (select * from m where result = 'matched'), a as (select fill_id, 'missing_exchange' as kind, 'high' as severity from internal where fill_id not in (select internal_id from ok) and ts < timestamp '2001-01-01'),
 b as (select fill_id, 'missing_internal' as kind, 'critical' as severity from exchange where fill_id not in (select exchange_id from ok) and ts < timestamp '2001-01-01')
 select substr(md5(concat_ws(':', kind, fill_id)), 1, 12) as break_id, fill_id, kind, severity from (select * from a union all select * from b)"""
)
def jn7_missing_fills(spark, d):
    a, b = _fills(spark, d)
    return L.missing_fills(a, b, L.match_fills(a, b), "2001-01-01 00:00:00", 0)


@query(
    f"""with {V.FILLS}, a as (select symbol, sum(case when side = 'buy' then 1 else -1 end * quantity * price) as a from internal group by 1), b as (select symbol, sum(case when side = 'buy' then 1 else -1 end * quantity * price) as b from exchange group by 1),
 j as (select coalesce(a.symbol, b.symbol) as symbol, coalesce(a, 0) as i, coalesce(b, 0) as x from a full join b on a.symbol = b.symbol)
 select symbol, round(i, 4) as internal, round(x, 4) as exchange, abs(i - x) > greatest(abs(i), abs(x), 1) * 0.0001 as differs from j"""
)
def jn8_pnl_reconciliation(spark, d):
    return rounded(L.pnl_reconciliation(*_fills(spark, d)), 4)


@query(f"with {_PANEL} select a, b, ts, round(x, 6) as x, round(y, 6) as y from pan where (a, b) in (select (a, b) from pan group by a, b having count(*) >= 30)")
def jn9_pair_panel(spark, d):
    return rounded(P.pair_panel(_returns(spark, d)))


_COINT = f"""{V.BARS}, pan as (select x.symbol as a, y.symbol as b, x.ts, x.close as x, y.close as y from bars x join bars y on x.ts = y.ts and x.symbol < y.symbol),
 f as (select a, b, regr_slope(x, y) as hedge, regr_intercept(x, y) as intercept from pan group by 1, 2 having count(*) >= 30),
 e as (select a, b, ts, hedge, intercept, x - intercept - hedge * y as e from pan join f using (a, b)), l as (select *, lag(e) over (partition by a, b order by ts) as l from e),
 g as (select a, b, hedge, intercept, sum((e - l) * l) as xy, sum(l * l) as xx, sum((e - l) * (e - l)) as yy, count(*) as n from l where l is not null group by 1, 2, 3, 4)"""


@query(f"with {_COINT} select a, b, round(hedge, 6) as hedge, round(intercept, 6) as intercept, n, round((xy / xx) / sqrt((yy - xy / xx * xy) / (n - 1) / xx), 6) as t, (xy / xx) / sqrt((yy - xy / xx * xy) / (n - 1) / xx) < -3.34 as cointegrated from g")
def jn10_cointegration(spark, d):
    bars = V.daily_bars(spark, d)
    return rounded(P.cointegration_of_series(bars, "close"))


_ITCH = """msg as (select l_orderkey as order_ref, case when l_linenumber = 1 then 'A' when l_linenumber in (2, 3) then 'E' when l_linenumber = 4 then 'X' when l_linenumber = 5 then 'D' when l_linenumber = 6 then 'U' else 'P' end as msg_type,
 l_quantity as shares, l_partkey as new_ref, l_shipdate as ts from lineitem)"""


def _messages(spark, d):
    kind = "case when l_linenumber = 1 then 'A' when l_linenumber in (2, 3) then 'E' when l_linenumber = 4 then 'X' when l_linenumber = 5 then 'D' when l_linenumber = 6 then 'U' else 'P' end"
    return V.table(spark, d, "lineitem").selectExpr("l_orderkey order_ref", f"{kind} msg_type", "l_quantity shares", "l_partkey new_ref", "l_shipdate ts")


@query(
    f"""with {_ITCH}, g as (select order_ref, sum(case when msg_type = 'A' then shares else 0 end) as added, sum(case when msg_type = 'E' then shares else 0 end) as executed, sum(case when msg_type = 'X' then shares else 0 end) as cancelled,
 count(case when msg_type = 'D' then 1 end) > 0 as deleted, max(case when msg_type = 'U' then new_ref end) as replaced_by, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as lifetime_s from msg group by 1)
 select *, case when deleted or replaced_by is not null then 0 else added - executed - cancelled end as remaining from g"""
)
def jn13_order_lifecycle(spark, d):
    return L.order_lifecycle(_messages(spark, d))


@query(f"with {_ITCH} select msg_type, count(*) as n from msg group by 1")
def ag34_message_stats(spark, d):
    return L.message_stats(_messages(spark, d))


@query(f"with {_ITCH}, s as (select distinct order_ref % 50 as session, order_ref as seq from msg where msg_type = 'A'), l as (select session, seq, lag(seq) over (partition by session order by seq) as l from s) select session, l + 1 as gap_begin, seq - 1 as gap_end from l where seq > l + 1")
def ag35_sequence_gaps(spark, d):
    return L.sequence_gaps(_messages(spark, d).filter("msg_type = 'A'").selectExpr("order_ref % 50 session", "order_ref seq"))


@query(
    f"""with recursive {_MATCH}, k as (select count(case when result = 'matched' then 1 end) as matched, count(case when result = 'quantity' then 1 end) as quantity, count(case when result = 'price' then 1 end) as price, count(case when result = 'timestamp_drift' then 1 end) as timestamp_drift from m),
 i as (select count(*) as n_internal, sum(quantity * price) as notional_internal from internal), x as (select count(*) as n_exchange, sum(quantity * price) as notional_exchange from exchange)
 select n_internal, n_exchange, round(notional_internal, 2) as notional_internal, round(notional_exchange, 2) as notional_exchange, matched, quantity, price, timestamp_drift, round(notional_internal - notional_exchange, 2) as difference,
 round(100.0 * matched / greatest(n_internal, n_exchange), 2) as match_rate from i, x, k"""
)
def ag9_eod_report(spark, d):
    a, b = _fills(spark, d)
    return rounded(L.eod_report(a, b, L.match_fills(a, b)), 2)


@query(f"with recursive {_MATCH} select internal_id, case when result = 'timestamp_drift' then 'resolved_auto' else 'open' end as status from m where result <> 'matched'")
def ag10_resolve_drift(spark, d):
    breaks = L.match_fills(*_fills(spark, d)).filter("result <> 'matched'").withColumn("status", F.lit("open"))
    return L.resolve_drift_breaks(breaks).select("internal_id", "status")


_OE = """oe as (select o_orderkey as order_id, 'new' as event_type, 0 as sequence, 150.0 as order_quantity, cast(null as double) as quantity, cast(null as double) as price from orders
 union all select l_orderkey, case when l_linenumber = 7 then 'cancel' else 'fill' end, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice), null, l_quantity, l_extendedprice / l_quantity from lineitem)"""


@query(
    f"""with {_OE}, g as (select order_id, max_by(event_type, sequence) as last, max(order_quantity) as quantity, coalesce(sum(case when event_type = 'fill' then quantity end), 0) as filled,
 sum(case when event_type = 'fill' then quantity * price end) / nullif(sum(case when event_type = 'fill' then quantity end), 0) as avg_price, count(case when event_type = 'fill' then 1 end) as n_fills from oe group by 1)
 select order_id, cast(quantity as double) as quantity, filled, round(avg_price, 6) as avg_price, n_fills, case when n_fills > 0 and filled >= quantity then 'filled' when n_fills > 0 and last = 'fill' then 'partial' else last end as status from g"""
)
def ag11_order_state(spark, d):
    from pyspark.sql import Window

    new = V.orders_flow(spark, d).selectExpr("order_id", "'new' event_type", "0L sequence", "150D order_quantity", "cast(null as double) quantity", "cast(null as double) price")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    fills = V.table(spark, d, "lineitem").withColumn("sequence", n)
    fills = fills.selectExpr("l_orderkey order_id", "case when l_linenumber = 7 then 'cancel' else 'fill' end event_type", "sequence", "cast(null as double) order_quantity", "l_quantity quantity", "l_extendedprice / l_quantity price")
    return rounded(L.order_state(new.unionByName(fills)))


def positions_sql(trades: str) -> str:
    """Average cost and realised profit trade by trade: adding to a position averages the cost, a flip through zero restarts it."""
    grows = "f.position = 0 or f.position * k.q > 0"
    return f"""{V.FILLS},
k as (
  select fill_id, account, symbol, price as p, case when side = 'buy' then quantity else -quantity end as q,
    row_number() over (partition by account, symbol order by ts, fill_id) as i
  from {trades}
),
f as (
  select fill_id, account, symbol, i, cast(q as double) as position, cast(p as double) as avg_cost, cast(0 as double) as realized from k where i = 1
  union all
  select k.fill_id, k.account, k.symbol, k.i, f.position + k.q,
    case when {grows} then (abs(f.position) * f.avg_cost + abs(k.q) * k.p) / (abs(f.position) + abs(k.q))
      when f.position + k.q = 0 then 0 when (f.position + k.q) * f.position < 0 then k.p else f.avg_cost end,
    f.realized + case when {grows} then 0 else least(abs(k.q), abs(f.position)) * (k.p - f.avg_cost) * sign(f.position) end
  from f join k on f.account = k.account and f.symbol = k.symbol and k.i = f.i + 1
)"""


@query(f"with recursive {positions_sql('internal')} select fill_id, account, symbol, round(position, 4) as position, round(avg_cost, 4) as avg_cost, round(realized, 4) as realized from f")
def ag12_position_state(spark, d):
    return rounded(L.position_state(V.fills_internal(spark, d)).select("fill_id", "account", "symbol", "position", "avg_cost", "realized"), 4)


@query(f"with {V.FILLS} select fill_id, account, symbol, round(sum(case when side = 'buy' then quantity else -quantity end) over (partition by account, symbol order by ts, fill_id), 6) as position from internal")
def ag12_position_quantity(spark, d):
    return rounded(L.position_quantity(V.fills_internal(spark, d)).select("fill_id", "account", "symbol", "position"))


@query(
    f"""with {V.FILLS}, e as (select account, symbol, sum(quantity * price) as v from internal group by 1, 2), g as (select account, sum(abs(v)) as gross, sum(v) as net, max(abs(v)) / nullif(sum(abs(v)), 0) as largest_share from e group by 1)
 select account, round(gross, 4) as gross, round(net, 4) as net, round(largest_share, 4) as largest_share, round(gross / 1e6, 4) as leverage, gross / 1e6 > 2 as over_leverage, largest_share > 0.25 as over_share from g"""
)
def ag13_exposure_summary(spark, d):
    return rounded(L.exposure_summary(V.fills_internal(spark, d), 1e6), 4)


@query(f"with {V.FILLS} select account, strategy, round(sum(case when side = 'buy' then 1 else -1 end * quantity * price), 2) as notional, count(*) as n, cast(grouping(account) * 2 + grouping(strategy) as int) as level from internal group by rollup (account, strategy)")
def ag14_exposure_rollup(spark, d):
    return rounded(L.exposure_rollup(V.fills_internal(spark, d)), 2)


@query(f"with {V.TICKS}, l as (select symbol, price, sum(size) as size from ticks where side = 'B' group by 1, 2), k as (select *, cast(row_number() over (partition by symbol order by price desc) as int) as level from l) select symbol, price, size, level from k where level <= 3")
def tk3_top_levels(spark, d):
    return L.top_levels(V.ticks(spark, d), "B", 3)


@query(f"with {V.TICKS} select symbol as aggregate_id, seq as sequence, side as event_type from ticks where symbol = 3 and side = 'B' and seq > 100")
def tk5_read_events(spark, d):
    events = V.ticks(spark, d).selectExpr("symbol aggregate_id", "seq sequence", "side event_type")
    return L.read_events(events, 3, "B", 100)


@query(f"with {V.TICKS} select count(*) as n, cast(sum(cast(('0x' || substr(sha256(concat_ws('|', seq, symbol, side)), 1, 15)) as hugeint)) as varchar) as checksum from ticks")
def tk6_ordered_checksum(spark, d):
    return L.ordered_checksum(V.ticks(spark, d), ["seq", "symbol", "side"])


@query(f"with {V.TICKS} select side, min(price) as min, max(price) as max, round(avg(price), 6) as avg, round(quantile_cont(price, 0.5), 6) as p50, round(quantile_cont(price, 0.99), 6) as p99, count(price) as n from ticks group by 1")
def ag33_latency_stats(spark, d):
    out = L.latency_stats(V.ticks(spark, d), "price", ["side"])
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("avg", "p50", "p99")})


# ---- portfolio

_PORT = f"{_RET}, port as (select symbol % 3 as portfolio, ts, avg(ret) as ret from r group by 1, 2)"


def _port(spark, d):
    r = _returns(spark, d)
    return r.groupBy((F.col("symbol") % 3).alias("portfolio"), "ts").agg(F.avg("ret").alias("ret"))


_VAR = "q as (select portfolio, quantile_cont(ret, 0.05) as q from port group by 1), v as (select portfolio, abs(any_value(q)) as var, abs(avg(ret)) as cvar from port join q using (portfolio) where ret <= q group by 1)"


@query(f"with {_PORT}, {_VAR} select portfolio, round(var, 6) as var, round(cvar, 6) as cvar from v")
def ag15_var_cvar(spark, d):
    return rounded(P.portfolio_var_cvar(_port(spark, d)))


_DD = "e as (select *, exp(sum(ln(1 + ret)) over (partition by portfolio order by ts rows unbounded preceding)) as equity from port), dd as (select *, equity / max(equity) over (partition by portfolio order by ts rows unbounded preceding) - 1 as drawdown from e)"


@query(f"with {_PORT}, {_VAR}, {_DD} select portfolio, round(stddev_samp(ret) * sqrt(252), 6) as volatility, round(stddev_samp(case when ret < 0 then ret end) * sqrt(252), 6) as downside, round(min(drawdown), 6) as max_drawdown, round(any_value(var), 6) as var, round(any_value(cvar), 6) as cvar from dd join v using (portfolio) group by 1")
def ag16_risk_metrics(spark, d):
    return rounded(P.risk_metrics(_port(spark, d)))


@query(
    f"""with {V.BARS}, s as (select symbol as portfolio, ts, close as equity, close / lag(close) over w - 1 as r, max(close) over (partition by symbol order by ts rows unbounded preceding) as p from bars window w as (partition by symbol order by ts)),
 g as (select portfolio, max_by(equity, ts) / min_by(equity, ts) - 1 as total_return, count(r) as n, sqrt(252) * avg(r - 0.02 / 252) / nullif(stddev_samp(r - 0.02 / 252), 0) as sharpe,
 sqrt(252) * avg(r - 0.02 / 252) / nullif(stddev_samp(case when r - 0.02 / 252 < 0 then r - 0.02 / 252 end), 0) as sortino, max(1 - equity / p) as max_drawdown from s group by 1),
 h as (select *, pow(1 + total_return, 252.0 / nullif(n, 0)) - 1 as annual_return from g)
 select portfolio, round(total_return, 6) as total_return, round(sharpe, 6) as sharpe, round(sortino, 6) as sortino, round(max_drawdown, 6) as max_drawdown, round(annual_return, 6) as annual_return, round(annual_return / nullif(max_drawdown, 0), 6) as calmar from h"""
)
def ag17_performance(spark, d):
    return rounded(P.performance_metrics(V.daily_bars(spark, d).select(F.col("symbol").alias("portfolio"), "ts", F.col("close").alias("equity"))))


@query(
    f"""with {_RET}, t as (select symbol as portfolio, ts, ret as pnl, ret > 0 as w from r), n as (select *, case when lag(w) over (partition by portfolio order by ts) = w then 0 else 1 end as n from t),
 u as (select *, sum(n) over (partition by portfolio order by ts rows unbounded preceding) as run from n), s as (select portfolio, run, w, count(*) as len from u group by 1, 2, 3),
 k as (select portfolio, coalesce(max(case when w then len end), 0) as win_streak, coalesce(max(case when not w then len end), 0) as loss_streak from s group by 1),
 g as (select portfolio, count(*) as n, avg(case when w then 1.0 else 0.0 end) as win_rate, sum(case when w then pnl end) / nullif(abs(sum(case when not w then pnl end)), 0) as profit_factor, coalesce(abs(sum(case when not w then pnl end)), 0) = 0 as no_losses,
 avg(case when w then pnl end) as avg_win, avg(case when not w then pnl end) as avg_loss from t group by 1)
 select portfolio, n, round(win_rate, 6) as win_rate, round(profit_factor, 6) as profit_factor, no_losses, round(avg_win, 6) as avg_win, round(avg_loss, 6) as avg_loss, win_streak, loss_streak from g join k using (portfolio)"""
)
def ag18_trade_statistics(spark, d):
    return rounded(P.trade_statistics(_returns(spark, d).select(F.col("symbol").alias("portfolio"), "ts", F.col("ret").alias("pnl"))))


_SWEEP = f"""{_RET}, dly as (select symbol % 4 as run, ts, sum(ret) / 1000 as ret, sum(ret) as pnl, count(*) as trades from r group by 1, 2), e as (select *, exp(sum(ln(1 + ret)) over (partition by run order by ts rows unbounded preceding)) as eq from dly),
 dd as (select *, eq / max(eq) over (partition by run order by ts rows unbounded preceding) - 1 as dd from e), g as (select run, sum(pnl) as pnl, cast(sum(trades) as bigint) as trades, sqrt(252) * avg(ret) / nullif(stddev_samp(ret), 0) as sharpe, min(dd) as max_drawdown from dd group by 1)"""


def _sweep(spark, d):
    return P.aggregate_sweep(_returns(spark, d).selectExpr("symbol % 4 run", "ts", "ret / 1000 ret", "ret pnl", "1L trades"))


@query(f"with {_SWEEP} select run, round(pnl, 6) as pnl, trades, round(sharpe, 6) as sharpe, round(max_drawdown, 6) as max_drawdown from g")
def ag19_aggregate_sweep(spark, d):
    return rounded(_sweep(spark, d))


@query(f"with {_SWEEP} select run, round(sharpe, 6) as sharpe from g order by sharpe desc, run")
def tk1_rank_runs(spark, d):
    return rounded(P.rank_runs(_sweep(spark, d)).select("run", "sharpe"))


_REG = f"{_RET}, g as (select *, case when ret > 0.1 then 'up' when ret < -0.1 then 'down' else 'flat' end as regime from r)"


def _regimes(spark, d):
    return _returns(spark, d).withColumn("regime", F.expr("case when ret > 0.1 then 'up' when ret < -0.1 then 'down' else 'flat' end"))


@query(
    f"""with {_REG}, e as (select *, exp(sum(ln(1 + ret)) over (partition by symbol, regime order by ts rows unbounded preceding)) as eq, count(*) over (partition by symbol) as t from g),
 dd as (select *, eq / max(eq) over (partition by symbol, regime order by ts rows unbounded preceding) - 1 as dd from e)
 select symbol, regime, count(*) as n, round(avg(ret), 6) as mean, round(stddev_samp(ret), 6) as vol, round(min(dd), 6) as max_drawdown, round(count(*) / any_value(t), 6) as share, round(avg(ret) / nullif(stddev_samp(ret), 0), 6) as mean_over_vol from dd group by 1, 2"""
)
def ag20_regime_statistics(spark, d):
    return rounded(P.regime_statistics(_regimes(spark, d)))


@query(f'with {_REG}, n as (select regime as f, lead(regime) over (partition by symbol order by ts) as t from g) select f as "from", t as "to", round(count(*) / sum(count(*)) over (partition by f), 6) as p from n where t is not null group by 1, 2')
def ag21_transition_matrix(spark, d):
    return rounded(P.transition_matrix(_regimes(spark, d)))


_CORR = f"with {V.BARS}, c as (select 'open' as feat_a, 'close' as feat_b, corr(open, close) as corr from bars union all select 'open', 'volume', corr(open, volume) from bars union all select 'close', 'volume', corr(close, volume) from bars)"


@query(f"{_CORR} select feat_a, feat_b, round(corr, 6) as corr from c")
def ag22_correlation(spark, d):
    return rounded(P.correlation_matrix(V.daily_bars(spark, d), ["open", "close", "volume"]))


#: Lags of close and volume, and their pairs as rows.
_WIDE = [f"{c}_{k}" for c in ("open", "high", "low", "close", "volume") for k in range(6)]
_WIDE_SQL = ", ".join(f"lag({c}, {k}) over (partition by symbol order by ts) as {c}_{k}" for c in ("open", "high", "low", "close", "volume") for k in range(6))


@query(
    f"""with {V.BARS}, wide as (select {_WIDE_SQL} from bars), c as (
  {" union all ".join(f"select '{a}' as feat_a, '{b}' as feat_b, corr({a}, {b}) as corr, count(case when {a} is not null then {b} end) as n from wide" for i, a in enumerate(_WIDE) for b in _WIDE[i + 1 :])}
)
select feat_a, feat_b, round(corr, 6) as corr, n from c"""
)
def ag22_correlation_wide(spark, d):
    """Thirty columns with nulls (lags), by tiles of eight columns."""
    bars = V.daily_bars(spark, d)
    wide = T.create_lags(bars, ["open", "high", "low", "close", "volume"], range(6)).select(*(F.col(f"{c.rsplit('_', 1)[0]}_lag_{c.rsplit('_', 1)[1]}").alias(c) for c in _WIDE))
    return rounded(P.correlation_pairs(wide, _WIDE, tile=8))


@query(f"{_CORR} select feat_a, feat_b, round(abs(corr), 6) as weight from c where abs(corr) > 0.3")
def ag22_feature_graph(spark, d):
    return rounded(P.feature_graph(V.daily_bars(spark, d), ["open", "close", "volume"], 0.3))


_COV = f"{_RET}, s as (select * from r), mu as (select symbol, avg(ret) * 252 as mu from s group by 1), cov as (select x.symbol as a, y.symbol as b, covar_samp(x.ret, y.ret) * 252 as cov, count(*) as n from s x join s y on x.ts = y.ts and x.symbol <= y.symbol group by 1, 2), w as (select symbol % 2 as portfolio, symbol, 1.0 / (1 + symbol) as weight from (select distinct symbol from s))"




@query(f"with {_COV} select a, b, round(cov, 6) as cov, n from cov")
def ag23_covariance(spark, d):
    return rounded(P.return_moments(_returns(spark, d))[1])


_PS = f"""{_COV}, pr as (select portfolio, sum(weight * mu) as ret from w join mu using (symbol) group by 1), pv as (select x.portfolio, sum(case when a = b then 1 else 2 end * x.weight * y.weight * cov) as var from w x join cov on x.symbol = a join w y on y.symbol = b and x.portfolio = y.portfolio group by 1)"""


@query(f"with {_PS} select portfolio, round(ret, 6) as ret, round(sqrt(greatest(var, 0)), 6) as vol, round(ret / nullif(sqrt(greatest(var, 0)), 0), 6) as ratio, round(0.1 / nullif(sqrt(greatest(var, 0)), 0), 6) as scale from pr join pv using (portfolio)")
def ag24_portfolio_stats(spark, d):
    s = stored(_returns(spark, d), "returns")
    w = s.select("symbol").distinct().selectExpr("symbol % 2 portfolio", "symbol", "1.0D / (1 + symbol) weight")
    return rounded(P.vol_target(P.portfolio_stats_of_returns(s, w), 0.1))


@query(f"with {_PANEL}, c as (select a, b, corr(x, y) as c from pan group by 1, 2 having count(*) >= 30) select a, b, round(sqrt(greatest((1 - c) / 2, 0)), 6) as distance from c")
def ag25_corr_distance(spark, d):
    return rounded(P.corr_distance(_returns(spark, d), 30))


@query(f"with {_COV}, c as (select symbol, 1.0 * symbol as cap from mu), cw as (select symbol, cap / (select sum(cap) from c) as w from c), f as (select a, b, cov from cov union all select b, a, cov from cov where a <> b) select a as symbol, round(2.5 * sum(cov * w), 6) as implied from f join cw on f.b = cw.symbol group by 1")
def ag26_market_implied(spark, d):
    s = stored(_returns(spark, d), "returns")
    return rounded(P.market_implied_of_returns(s, s.select("symbol").distinct().selectExpr("symbol", "1.0D * symbol cap")))


def _bin_sql(c: str, bins: int = 10) -> str:
    return f"least(floor(({c} - (select min({c}) from bars)) / nullif((select max({c}) - min({c}) from bars), 0) * {bins}) + 1, {bins})"


@query(
    f"""with {V.BARS}, z as (select 'volume' as feature, {_bin_sql('volume')} as x, {_bin_sql('close')} as y from bars union all select 'open', {_bin_sql('open')}, {_bin_sql('close')} from bars),
 j as (select feature, x, y, count(*) as n from z group by 1, 2, 3), t as (select feature, n, sum(n) over (partition by feature) as t, sum(n) over (partition by feature, x) as nx, sum(n) over (partition by feature, y) as ny from j)
 select feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) as mi from t group by 1"""
)
def ag27_mutual_information(spark, d):
    return rounded(P.binned_mutual_information(V.daily_bars(spark, d), "close", ["volume", "open"]))


@query(
    f"""with {V.BARS}, z as (select symbol, ts, {_bin_sql('close')} as y, {_bin_sql('volume')} as x from bars), l as (select y as a, lag(y) over w as b, lag(x) over w as c from z window w as (partition by symbol order by ts)),
 j as (select a, b, c, count(*) as n from l where b is not null and c is not null group by 1, 2, 3), t as (select n, sum(n) over (partition by b) as nb, sum(n) over (partition by b, c) as nbc, sum(n) over (partition by a, b) as nab from j)
 select cast(sum(n) as bigint) as n, round(greatest(sum(n * log2(n * nb / (nbc * nab))) / sum(n), 0), 6) as te from t"""
)
def ag28_transfer_entropy(spark, d):
    return rounded(P.transfer_entropy(V.daily_bars(spark, d), "volume", "close"))


@query(
    f"""with {V.BARS}, l as (select close, lag(volume, 1) over w as v1, lag(volume, 2) over w as v2 from bars window w as (partition by symbol order by ts)),
 c as (select 'volume' as feature, 1 as lag, abs(corr(v1, close)) as abs_corr from l union all select 'volume', 2, abs(corr(v2, close)) from l)
 select feature, lag, round(abs_corr, 6) as abs_corr, row_number() over (partition by feature order by abs_corr desc, lag) = 1 as best from c"""
)
def ag29_lag_correlations(spark, d):
    return rounded(P.lag_correlations(V.daily_bars(spark, d), "close", ["volume"], 2))


@query(f"with {V.BARS} select round(greatest(0, abs(corr(open * volume, close)) - greatest(abs(corr(open, close)), abs(corr(volume, close)))), 6) as strength from bars")
def ag30_interaction(spark, d):
    return rounded(P.interaction_strength(V.daily_bars(spark, d), "open", "volume", "close"))


@query(f"with {V.BARS}, c as (select 'low' as feature, corr(low, open) as with_treatment, corr(low, close) as with_outcome from bars union all select 'volume', corr(volume, open), corr(volume, close) from bars) select feature, round(with_treatment, 6) as with_treatment, round(with_outcome, 6) as with_outcome from c where abs(with_treatment) > 0.3 and abs(with_outcome) > 0.3")
def ag31_confounders(spark, d):
    return rounded(P.find_confounders(V.daily_bars(spark, d), "open", "close", ["low", "volume"]))


@query()
def ag32_granger(spark, d):
    return rounded(P.granger(V.daily_bars(spark, d), "close", ["volume"], 2))


@query(
    f"""with {V.BARS}, v as (select symbol, close as y, lag(close) over w as y1, lag(volume) over w as x1 from bars window w as (partition by symbol order by ts)),
r as (select * from v where y1 is not null and x1 is not null),
a as (select symbol, regr_slope(y, y1) as sy, regr_intercept(y, y1) as ay, regr_slope(x1, y1) as sx, regr_intercept(x1, y1) as ax, count(*) as n from r group by 1),
e as (select symbol, n, y - ay - sy * y1 as ey, x1 - ax - sx * y1 as ex from r join a using (symbol)),
s as (select symbol, n, sum(ey * ey) as whole, sum(ey * ey) - power(sum(ex * ey), 2) / sum(ex * ex) as rest from e group by 1, 2)
select symbol, 'volume' as feature, 1 as lag, n, round((whole - rest) / (rest / (n - 3)), 5) as f from s where n > 3"""
)
def ag32_granger_f(spark, d):
    """The F statistic of one lag, whose fits SQL can express as regressions of residuals."""
    return rounded(P.lag_tests(V.daily_bars(spark, d), "close", ["volume"], 1, block_rows=200), 5)


# ---- whole series


_FRAC = ", ".join(f"({k}, {w!r})" for k, w in enumerate(P.frac_diff_weights(0.5, 1e-3).tolist()))


@query(
    f"""with {V.BARS}, w(k, w) as (values {_FRAC}), b as (select symbol, ts, close, row_number() over (partition by symbol order by ts) as i from bars),
 s as (select x.symbol, x.ts, sum(w.w * y.close) as frac from b x, w, b y where x.symbol = y.symbol and y.i = x.i - w.k and x.i > (select count(*) from w) group by 1, 2)
 select b.symbol, b.ts, round(frac, 6) as frac from b left join s using (symbol, ts)"""
)
def se1_frac_diff(spark, d):
    return rounded(P.frac_diff(V.daily_bars(spark, d), threshold=1e-3))


_PLACED = f"""{V.BARS}, pos as (
  select symbol, ts, close as x, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as n from bars
)"""


@query(
    f"""with {_PLACED}, t as (
  select *, case when i >= 10 and i + 10 < n and n > 21 then (sum(x) over (partition by symbol order by i rows between 10 preceding and 10 following)
    - (lag(x, 10) over (partition by symbol order by i) + lead(x, 10) over (partition by symbol order by i)) / 2) / 20 end as t
  from pos
),
e as (select symbol, min_by(t, i) filter (t is not null) as t0, max_by(t, i) filter (t is not null) as t1, avg(x) as m from t group by 1),
r as (select symbol, ts, i, x, coalesce(t, case when i < 10 then t0 else t1 end, m) as trend from t join e using (symbol)),
p as (select symbol, i % 20 as phase, avg(x - trend) as m from r group by all),
q as (select symbol, sum(m) / 20 as mid from p group by 1)
select r.symbol, ts, round(trend, 3) as trend, round(m - mid, 3) as seasonal, round(x - trend - (m - mid), 3) as residual
from r join p on r.symbol = p.symbol and r.i % 20 = p.phase join q on r.symbol = q.symbol"""
)
def se2_decompose(spark, d):
    return rounded(S.seasonal_decompose(V.daily_bars(spark, d), 20), 3)


#: One row for each tap of the two filters, over the square root of two.
_TAPS = ", ".join(f"({m}, {low!r} / sqrt(2), {high!r} / sqrt(2))" for m, (low, high) in enumerate(zip(S.DB4, S.HIGH)))


def _level(k: int, last: str) -> str:
    far = f"(b.i + {1 << (k - 1)} * f.m) % b.n"
    return f"""l{k} as (select b.symbol, b.i, b.n, sum(f.high * y.a) as d, sum(f.low * y.a) as a
  from {last} b, taps f, {last} y where y.symbol = b.symbol and y.i = {far} group by all)"""


@query(
    f"""with {_PLACED}, taps(m, low, high) as (values {_TAPS}), l0 as (select symbol, i, n, x as a from pos), {_level(1, 'l0')}, {_level(2, 'l1')}, {_level(3, 'l2')}
select pos.symbol, ts, round(l1.d, 5) as detail_1, round(l2.d, 5) as detail_2, round(l3.d, 5) as detail_3, round(l3.a, 5) as approximation
from pos join l1 using (symbol, i) join l2 using (symbol, i) join l3 using (symbol, i)"""
)
def se3_wavelet(spark, d):
    return rounded(S.wavelet_bank(V.daily_bars(spark, d), block_rows=200), 5)


def _dft(table: str, value: str) -> str:
    """Plain sums of sines and cosines."""
    angle = "2 * pi() * ((a.i * k.i) % a.n) / a.n"
    return f"""dft as (select a.symbol, k.i as k, a.n, sum(a.{value} * cos({angle})) as re, -sum(a.{value} * sin({angle})) as im
  from {table} a join {table} k using (symbol) group by all)"""


@query(
    f"""with {_PLACED}, {_dft('pos', 'x')},
h as (select *, case when k = 0 or 2 * k = n then 1 when 2 * k < n then 2 else 0 end as w from dft),
z as (
  select p.symbol, p.ts, sum(w * (re * cos(2 * pi() * ((p.i * k) % p.n) / p.n) - im * sin(2 * pi() * ((p.i * k) % p.n) / p.n))) / any_value(p.n) as re,
    sum(w * (re * sin(2 * pi() * ((p.i * k) % p.n) / p.n) + im * cos(2 * pi() * ((p.i * k) % p.n) / p.n))) / any_value(p.n) as im
  from pos p join h on p.symbol = h.symbol and w > 0 group by 1, 2
)
select symbol, ts, round(sqrt(re * re + im * im), 3) as amplitude, round(atan2(im, re), 3) as phase from z"""
)
def se4_analytic(spark, d):
    """Series of over 300 values go through the distributed transform."""
    return rounded(S.analytic_signal(V.daily_bars(spark, d), longest=300), 3)


@query(
    f"""with {_PLACED}, level as (select symbol, i, n, x - avg(x) over (partition by symbol) as x from pos), {_dft('level', 'x')},
p as (select symbol, cast(k as double) / n as f, case when k > 0 then re * re + im * im end as p from dft where 2 * k <= n),
t as (select symbol, nullif(sum(p), 0) as s, sum(f * p) / nullif(sum(p), 0) as c, sum(case when p > 0 then p * log2(p) end) as l from p group by 1),
m as (
  select symbol, s, c, l, sqrt(sum(power(f - c, 2) * p.p) / s) as d, sum(power(f - c, 3) * p.p) / s as m3, sum(power(f - c, 4) * p.p) / s as m4
  from p join t using (symbol) group by symbol, s, c, l
)
select symbol, round(c, 6) as centroid, round(d, 6) as spread, round(m3 / power(nullif(d, 0), 3), 6) as skew, round(m4 / power(nullif(d, 0), 4), 6) as kurtosis,
  round(log2(s) - l / s, 6) as entropy
from m"""
)
def se5_spectral(spark, d):
    """Series of over 300 values go through the distributed transform."""
    return rounded(S.spectral_features(V.daily_bars(spark, d), longest=300))


@query(
    f"""with {V.BARS}, s as (select symbol, k, close - lag(close, k) over (partition by symbol, k order by ts) as d from bars, (select unnest(generate_series(2, 19)) as k)),
 p as (select symbol, ln(k) as x, ln(nullif(stddev_pop(d), 0)) as y from s group by symbol, k) select symbol, round(regr_slope(y, x), 6) as hurst from p group by 1"""
)
def se6_hurst(spark, d):
    return rounded(P.hurst(V.daily_bars(spark, d)))


@query(
    f"""with {_RET}, m as (select symbol, avg(ret) as m, count(*) as n from r group by 1), y as (select r.symbol, n, sum(ret - m) over (partition by r.symbol order by ts rows unbounded preceding) as y, row_number() over (partition by r.symbol order by ts) - 1 as i from r join m on r.symbol = m.symbol),
 g as (select symbol, n, y, cast(i as double) as i, s, floor(i / s) as g from y, (select unnest([4, 8, 16, 32]) as s)), k as (select symbol, s, g, regr_syy(y, i) - pow(regr_sxy(y, i), 2) / regr_sxx(y, i) as q from g where (g + 1) * s <= n group by 1, 2, 3),
 f as (select symbol, s, sqrt(avg(greatest(q / s, 0))) as f from k group by 1, 2) select symbol, round(regr_slope(ln(f), ln(s)), 6) as dfa from f where f > 0 group by 1"""
)
def se7_dfa(spark, d):
    return rounded(P.dfa(_returns(spark, d)))
