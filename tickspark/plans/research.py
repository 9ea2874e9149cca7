"""Queries of point-in-time joins, signals, backtests, schedules, risk screening and alternative data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as Q
from ..operators import altdata as A
from ..operators import bars as B
from ..operators import pit as I
from ..operators import strategy as S
from ..operators import technical as T
from ..sources import views as V
from .registry import query, rounded

# hourly features of each symbol, and ticks as the entities
_FEAT = f"""{V.TICKS}, feat as (select symbol as entity_id, time_bucket(interval 6 hours, ts) + interval 6 hours as ts, avg(price) as mean_price, sum(size) as sum_size from ticks group by 1, 2),
 ent as (select symbol as entity_id, ts, seq from ticks)"""


def features_long(spark, d):
    t = V.ticks(spark, d).groupBy(F.col("symbol").alias("entity_id"), F.window("ts", "6 hours").alias("w")).agg(F.avg("price").alias("mean_price"), F.sum("size").alias("sum_size"))
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("feature_name"), F.col(n).alias("value")) for n in ("mean_price", "sum_size"))))
    return t.select("entity_id", F.col("w.end").alias("ts"), cells.alias("x")).select("entity_id", "ts", "x.feature_name", "x.value", F.col("ts").alias("created_at"))


_AS_OF = f"""with {_FEAT}
select e.entity_id, e.seq, round(f.mean_price, 6) as mean_price, round(f.sum_size, 6) as sum_size
from ent e asof left join feat f on e.entity_id = f.entity_id and e.ts >= f.ts"""


@query(_AS_OF)
def jn3_point_in_time_buckets(spark, d):
    """The same rows as jn3_point_in_time, with entities of over five rows dealt by time bucket (so few, so that the small tables are cut as well)."""
    e = V.ticks(spark, d).select(F.col("symbol").alias("entity_id"), "ts", "seq")
    found = I.point_in_time_join(e, features_long(spark, d), ["mean_price", "sum_size"], entity_rows=5)
    return rounded(found.select("entity_id", "seq", "mean_price", "sum_size"))


@query(_AS_OF)
def jn3_point_in_time(spark, d):
    e = V.ticks(spark, d).select(F.col("symbol").alias("entity_id"), "ts", "seq")
    return rounded(I.point_in_time_join(e, features_long(spark, d), ["mean_price", "sum_size"]).select("entity_id", "seq", "mean_price", "sum_size"))


@query(
    f"""with {_FEAT}, g as (select distinct entity_id, t.ts from ent, (select unnest(generate_series(timestamp '2024-01-05', timestamp '2024-01-24', interval 1 day)) as ts) t)
 select g.entity_id, g.ts, round(f.mean_price, 6) as mean_price, round(f.sum_size, 6) as sum_size from g asof join feat f on g.entity_id = f.entity_id and g.ts >= f.ts where f.mean_price is not null and f.sum_size is not null"""
)
def jn4_training_dataset(spark, d):
    f = features_long(spark, d)
    return rounded(I.training_dataset(f, f, ["mean_price"], "sum_size", "2024-01-05 00:00:00", "2024-01-25 00:00:00", "1 day"))


@query(
    f"""with {_FEAT} select entity_id, ts, list_value(round(mean_price, 6), round(sum_size, 6), cast(0 as double)) as vector from feat"""
)
def sc9_feature_vectors(spark, d):
    f = features_long(spark, d).groupBy("entity_id", "ts").agg(F.map_from_entries(F.collect_list(F.struct("feature_name", (F.round(F.col("value") + 1e-9, 6)).alias("value")))).alias("features"))
    return I.to_vector(f, ["mean_price", "sum_size", "none"], fill=0.0).select("entity_id", "ts", "vector")


@query(
    f"""with {V.BARS}, x as (select symbol, ts, close / nullif(lag(close) over w, 0) - 1 as ret_1, case when count(close) over v = 5 then avg(close) over v end as sma_5, lead(close, 5) over w / close - 1 as label from bars
 window w as (partition by symbol order by ts), v as (partition by symbol order by ts rows 4 preceding)) select symbol, ts, round(ret_1, 6) as ret_1, round(sma_5, 6) as sma_5, round(label, 6) as label from x where ret_1 is not null and sma_5 is not null and label is not null"""
)
def w1_research_table(spark, d):
    reg = I.FeatureRegistry()
    reg.register("returns", lambda f: T.returns(f))
    reg.register("means", lambda f: T.sma(f, (5,)), needs=("returns",))
    reg.register("label", lambda f: T.forward_label(f), needs=("means",))
    out = reg.build(V.daily_bars(spark, d), ["label"]).select("symbol", "ts", "ret_1", "sma_5", "label")
    return rounded(out.dropna())


# ---- signals and backtests

_Z = f"{V.BARS}, s as (select symbol, avg(close) as m, stddev_pop(close) as sd from bars group by 1), z as (select bars.symbol, ts, (close - m) / nullif(sd, 0) as z from bars join s on bars.symbol = s.symbol)"


@query(
    f"""with {_Z}, g as (select *, sum(case when abs(z) < 0.5 then 1 else 0 end) over (partition by symbol order by ts rows unbounded preceding) as seg, case when z > 1.5 then -1 when z < -1.5 then 1 end as e from z)
 select symbol, ts, round(z, 6) as zscore, coalesce(first_value(e ignore nulls) over (partition by symbol, seg order by ts rows unbounded preceding), 0) as position from g"""
)
def sg1_mean_reversion(spark, d):
    return rounded(S.mean_reversion_signal(V.daily_bars(spark, d), entry=1.5).select("symbol", "ts", "zscore", "position"))


_MOM = f"""{V.RETURNS}, y as (select returns.symbol, returns.ts, close, ret, avg(ret) over w as m, stddev_pop(ret) over w as s, count(ret) over w as n from returns join bars using (symbol, ts)
 window w as (partition by returns.symbol order by returns.ts rows between 19 preceding and 1 preceding)),
 k as (select symbol, ts, cast(close as double) as p, coalesce(case when n = 19 then case when s = 0 then 0 else (ret - m) / nullif(s, 0) end end, 0) as z, row_number() over (partition by symbol order by ts) as i from y),
 f as (select symbol, ts, i, case when abs(z) > 1 then cast(sign(z) as int) else 0 end as pos, case when abs(z) > 1 then p else 0.0 end as paid from k where i = 1
 union all select symbol, ts, i, case when was = 0 then case when abs(z) > 1 then cast(sign(z) as int) else 0 end when leaves then 0 else was end,
 case when was = 0 then case when abs(z) > 1 then p else paid end when leaves then 0.0 else paid end from
 (select k.symbol, k.ts, k.i, k.p, k.z, f.pos as was, f.paid, f.pos * k.z < 0 or (f.paid <> 0 and f.pos * (k.p / nullif(f.paid, 0) - 1) < -0.05) as leaves from f join k on f.symbol = k.symbol and k.i = f.i + 1))"""


@query(f"with recursive {_MOM} select symbol, ts, pos as position, round(paid, 6) as entry_price from f")
def sg2_momentum_positions(spark, d):
    return rounded(S.momentum_positions(V.daily_bars(spark, d)).select("symbol", "ts", "position", "entry_price"))


@query(
    f"""with recursive {_Z}, k as (select symbol, ts, z, row_number() over (partition by symbol order by ts) as i from z),
 f as (select symbol, i, ts, case when z > 1.5 then -1 when z < -1.5 then 1 else 0 end as p from k where i = 1
 union all select k.symbol, k.i, k.ts, case when f.p = 0 then case when k.z > 1.5 then -1 when k.z < -1.5 then 1 else 0 end when (f.p = 1 and k.z > -0.5) or (f.p = -1 and k.z < 0.5) then 0 else f.p end from f join k on f.symbol = k.symbol and k.i = f.i + 1)
 select symbol, ts, p as position from f"""
)
def sg3_pairs_positions(spark, d):
    z = S.mean_reversion_signal(V.daily_bars(spark, d), entry=1.5).drop("position")
    return S.pairs_positions(z, entry=1.5, leave=0.5).select("symbol", "ts", "position")


def _quoted(spark, d):
    return V.daily_bars(spark, d).selectExpr("symbol", "ts", "close", "close * 0.9995 bid", "close * 1.0005 ask")


@query()
def bt1_backtest(spark, d):
    return rounded(S.backtest(_quoted(spark, d), S.param_grid(spark, {"lookback": [20], "entry": [1.0]})), 4)


@query()
def bt2_sweep(spark, d):
    return rounded(S.sweep(_quoted(spark, d), S.param_grid(spark, {"lookback": [10, 20], "entry": [1.0, 2.0]})), 4)


_WF = f"""{V.BARS}, ends as (select min(ts) as a, max(ts) as b from bars), wf as (select row_number() over (order by t) - 1 as fold, t - interval 365 days as train_start, t as train_end, t as test_start, t + interval 180 days as test_end
 from (select unnest(generate_series(a + interval 365 days, b - interval 180 days, interval 180 days)) as t from ends))"""


@query(f"with {_WF} select fold, train_start, train_end, test_start, test_end from wf")
def bt3_walk_forward(spark, d):
    return S.walk_forward_of(V.daily_bars(spark, d), 365, 180).withColumn("fold", F.col("fold").cast("long"))


@query(f"with {_WF} select symbol, ts, fold, case when ts < train_end then 'train' else 'test' end as part from bars join wf on ts >= train_start and ts < test_end")
def bt3_assign_windows(spark, d):
    bars = V.daily_bars(spark, d)
    return S.assign_windows(bars, S.walk_forward_of(bars, 365, 180)).selectExpr("symbol", "ts", "cast(fold as bigint) fold", "part")


@query(
    f"""with {V.BARS}, k as (select symbol, ts, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as c from bars), l as (select *, greatest(c // 5, 1) as len from k),
 f as (select l.*, fold, fold * len as a, case when fold = 4 then c else fold * len + len end as b from l, (select unnest(generate_series(0, 4)) as fold))
 select symbol, ts, cast(fold as int) as fold, case when i >= a and i < b then 'test' when i >= b and i < b + 5 then 'embargo' else 'train' end as part from f"""
)
def bt4_purged_cv(spark, d):
    return S.purged_cv_assign(V.daily_bars(spark, d)).select("symbol", "ts", "fold", "part")


@query(f"with {V.TICKS} select run, symbol, chunk_start from (select distinct symbol from ticks), (select unnest([0, 1, 2, 3]) as run), (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-29', interval 7 days)) as chunk_start)")
def jn12_sweep_cross(spark, d):
    grid = S.param_grid(spark, {"lookback": [10, 20], "entry": [1.0, 2.0]})
    return S.sweep_cross(grid, V.ticks(spark, d), "2024-01-01 00:00:00", "2024-01-29 00:00:00", "7 days")


# ---- schedules

_ORD = "ord as (select o_orderkey as order_id, o_orderdate as ts, o_totalprice / 100 as quantity, o_custkey % 10 + 1 as symbol, (o_orderkey % 10) / 10.0 as urgency from orders)"


def _orders(spark, d):
    return V.table(spark, d, "orders").selectExpr("o_orderkey order_id", "o_orderdate ts", "o_totalprice / 100 quantity", "o_custkey % 10 + 1 symbol", "(o_orderkey % 10) / 10D urgency")


@query(f"with {_ORD} select order_id, cast(s as int) as slice, ts + s * interval 60 seconds as at, round(quantity / 5, 6) as quantity from ord, (select unnest(generate_series(0, 4)) as s)")
def ex1_twap(spark, d):
    return rounded(S.twap_schedule(_orders(spark, d), 5, 60))


_VS = f"""{V.BARS}, k as (select symbol, volume, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as c, sum(volume) over (partition by symbol) as v from bars),
 sh as (select symbol, least(i * 10 // c, 9) as slice, sum(volume) / nullif(any_value(v), 0) as s from k group by 1, 2)"""


@query(f"with {_ORD}, {_VS} select order_id, cast(slice as int) as slice, round(quantity * s, 6) as quantity from ord join sh using (symbol)")
def ex2_vwap(spark, d):
    return rounded(S.vwap_schedule(_orders(spark, d), V.daily_bars(spark, d), 10))


_ADV = "adv as (select symbol, avg(volume) as adv from bars group by 1)"


@query(f"with {_ORD}, {V.BARS}, {_ADV}, e as (select *, adv * 2.5 as each from ord join adv using (symbol)), n as (select *, least(ceil(quantity / each), 100) as n from e where each > 0) select order_id, cast(s as int) as slice, round(least(each, quantity - s * each), 6) as quantity from n, (select unnest(generate_series(0, 99)) as s) where s < n")
def ex3_pov(spark, d):
    adv = V.daily_bars(spark, d).groupBy("symbol").agg(F.avg("volume").alias("adv"))
    return rounded(S.pov_schedule(_orders(spark, d), adv, 2.5, 4.0))


_SINH = "((exp({0}) - exp(-({0}))) / 2)"


@query(f"with {_ORD} select order_id, cast(s as int) as slice, round(quantity * {_SINH.format('0.5 * (1 - s * 0.1)')} / {_SINH.format('0.5')} * 0.1, 6) as quantity from ord, (select unnest(generate_series(0, 9)) as s)")
def ex4_implementation_shortfall(spark, d):
    return rounded(S.is_schedule(_orders(spark, d)))


_MKT = "mkt as (select symbol, avg(volume) * 100 as avg_volume, 0.01 * (symbol % 4) as volatility from bars group by 1)"


@query(f"with {_ORD}, {V.BARS}, {_MKT} select order_id, case when urgency > 0.8 then 'twap' when volatility > 0.02 then 'is' when avg_volume > 10 * quantity then 'pov' else 'vwap' end as route from ord left join mkt using (symbol)")
def ex5_adaptive_route(spark, d):
    m = V.daily_bars(spark, d).groupBy("symbol").agg((F.avg("volume") * 100).alias("avg_volume")).withColumn("volatility", 0.01 * (F.col("symbol") % 4))
    return S.adaptive_route(_orders(spark, d), m).select("order_id", "route")


@query(
    f"""with {_ORD}, {_VS}, {_MKT}, rt as (select order_id, ord.symbol, quantity, avg_volume * 0.1 as each, case when urgency > 0.8 then 'twap' when volatility > 0.02 then 'is' when avg_volume > 10 * quantity then 'pov' else 'vwap' end as route from ord left join mkt using (symbol)),
 pv as (select *, least(ceil(quantity / each), 100) as n from rt where route = 'pov' and each > 0)
 select order_id, cast(s as int) as slice, round(quantity / 5, 6) as quantity from rt, (select unnest(generate_series(0, 4)) as s) where route = 'twap'
 union all select order_id, cast(s as int), round(quantity * {_SINH.format('0.5 * (1 - s * 0.1)')} / {_SINH.format('0.5')} * 0.1, 6) from rt, (select unnest(generate_series(0, 9)) as s) where route = 'is'
 union all select order_id, cast(slice as int), round(quantity * s, 6) from rt join sh using (symbol) where route = 'vwap'
 union all select order_id, cast(s as int), round(least(each, quantity - s * each), 6) from pv, (select unnest(generate_series(0, 99)) as s) where s < n"""
)
def ex5_adaptive_schedule(spark, d):
    b = V.daily_bars(spark, d)
    m = b.groupBy("symbol").agg((F.avg("volume") * 100).alias("avg_volume")).withColumn("volatility", 0.01 * (F.col("symbol") % 4))
    return rounded(S.adaptive_schedule(_orders(spark, d), m, b))


# ---- risk


@query("select o_orderkey as order_id, (select count(*) from orders p where p.o_custkey = o.o_custkey and p.o_orderdate > o.o_orderdate - interval 30 days and p.o_orderdate <= o.o_orderdate) as rate_long from orders o")
def rk2_order_rate(spark, d):
    return S.order_rate(V.orders_flow(spark, d), 1, 30 * 86400).select("order_id", "rate_long")


#: The accepted orders of the trailing 90 days, order by order; two fill the limit.
_ACC = """k as (select o_orderkey as order_id, o_custkey as entity, epoch_us(o_orderdate) as us, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as i from orders),
 f as (select entity, i, order_id, [us] as kept, false as throttled from k where i = 1
 union all select entity, i, order_id, case when len(w) >= 2 then w else list_append(w, us) end, len(w) >= 2 from
 (select k.entity, k.i, k.order_id, k.us, list_filter(f.kept, lambda x: x > k.us - 7776000000000) as w from f join k on f.entity = k.entity and k.i = f.i + 1))"""


@query(f"with recursive {_ACC} select order_id, throttled from f")
def rk2_accepted_rate(spark, d):
    return S.accepted_rate(V.orders_flow(spark, d), 2, 90 * 86400).select("order_id", "throttled")


_RK = """q as (select o_orderkey as order_id, o_custkey as entity, o_orderdate as ts, 10.0 as quantity, o_totalprice / 10 as price, o_totalprice / 10 * (1 + 0.05 * (o_orderkey % 3)) as ref_price, o_orderkey % 50 as rate from orders),
 st as (select c_custkey as entity, 5.0 * (c_custkey % 11) as position, 5e5 + c_acctbal as equity, 6e5 + c_acctbal as peak_equity, c_acctbal / 10 as daily_pnl, 1e5 * (c_custkey % 7) as gross, c_custkey % 97 = 0 as killed from customer),
 dec as (select q.*, case when killed then 'kill' when rate > 45 then 'throttle' when abs(quantity * price) > 400000 then 'reject' when abs(price / nullif(ref_price, 0) - 1) > 0.08 then 'reject' when abs(position + quantity) > 55 then 'reject'
 when daily_pnl < -50 then 'kill' when 1 - equity / nullif(peak_equity, 0) > 0.1655 then 'kill' when (gross + abs(quantity * price)) / nullif(equity, 0) > 1.5 then 'reject' else 'accept' end as decision from q left join st using (entity))"""


def _screened(spark, d, extra=()):
    q = V.table(spark, d, "orders").selectExpr("o_orderkey order_id", "o_custkey entity", "o_orderdate ts", "10D quantity", "o_totalprice / 10 price", "o_totalprice / 10 * (1 + 0.05D * (o_orderkey % 3)) ref_price", "o_orderkey % 50 rate")
    st = V.table(spark, d, "customer").selectExpr("c_custkey entity", "5D * (c_custkey % 11) position", "5e5D + c_acctbal equity", "6e5D + c_acctbal peak_equity", "c_acctbal / 10 daily_pnl", "1e5D * (c_custkey % 7) gross", "c_custkey % 97 = 0 killed")
    limits = {"rate": 45, "notional": 400000, "deviation": 0.08, "position": 55, "daily_loss": 50, "drawdown": 0.1655, "leverage": 1.5}
    return S.screen_orders(q, st, limits, extra)


@query(f"with {_RK} select order_id, case when decision = 'accept' and order_id % 7 = 0 then 'reject' else decision end as decision from dec")
def ud3_custom_risk_check(spark, d):
    """A user's check behind the built-in ones: a desk that is closed."""
    closed = (F.col("order_id") % 7 == 0, "reject", "closed_desk")
    return _screened(spark, d, [closed]).select("order_id", "decision")


@query(f"with {_RK} select order_id, decision from dec")
def rk1_screen_orders(spark, d):
    return _screened(spark, d).select("order_id", "decision")


@query(f"with {_RK} select order_id, case when coalesce(max(case when decision = 'kill' then 1 else 0 end) over (partition by entity order by ts, order_id rows between unbounded preceding and 1 preceding), 0) = 1 then 'kill' else decision end as decision from dec")
def rk3_latched_kill(spark, d):
    return S.latched_kill(_screened(spark, d)).select("order_id", "decision")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when l_returnflag = 'R' then -1 else 1 end * (l_extendedprice / l_quantity / 1000 - 1), 6) as pnl_pct, case when l_returnflag = 'R' then -1 else 1 end * (l_extendedprice / l_quantity / 1000 - 1) < -0.05 as stop from lineitem")
def rk4_stop_loss(spark, d):
    p = V.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "case when l_returnflag = 'R' then -1 else 1 end quantity", "l_extendedprice / l_quantity price", "1000D avg_cost")
    return rounded(S.stop_loss_flags(p).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pnl_pct", "stop"))


# ---- alternative data and scalars

POS, NEG = ["the", "with", "und"], ["of", "was", "der"]
_DOC = f"""dw as (select doc_id, source, list_distinct(regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9_]', ' ', 'g'), '[a-z0-9_]+')) as w from documents),
 sc as (select doc_id, source, len(list_intersect(w, {POS})) as p, len(list_intersect(w, {NEG})) as n from dw), ss as (select doc_id, source, coalesce((p - n) / nullif(cast(p + n as double), 0), 0) as score from sc)"""


def _scored(spark, d):
    return V.table(spark, d, "documents").withColumn("score", A.sentiment_score(F.col("text"), POS, NEG))


@query(f"with {_DOC} select doc_id, round(score, 6) as score, case when score > 0.3 then 'positive' when score < -0.3 then 'negative' else 'neutral' end as label from ss")
def sc1_sentiment(spark, d):
    return rounded(_scored(spark, d).withColumn("label", A.sentiment_label(F.col("score"))).select("doc_id", "score", "label"))


@query("select doc_id, substr(md5(concat_ws(':', source, lang, doc_id)), 1, 12) as record_id from documents")
def sc2_record_id(spark, d):
    return V.table(spark, d, "documents").select("doc_id", A.record_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("record_id"))


@query("select event_id, epoch_us(ts) as us, isodow(ts) - 1 as weekday, strftime(ts, '%H:%M:%S') as tod, strftime(ts, '%Y-%m') as year_month from events")
def sc3_dates(spark, d):
    return A.date_parts(V.table(spark, d, "events")).select("event_id", "us", "weekday", "tod", "year_month")


@query(f"with {V.BARS} select symbol, ts, round(open * volume, 4) as open_mul_volume, round(open / nullif(volume, 0), 4) as open_div_volume from bars")
def sc4_interactions(spark, d):
    return rounded(A.interaction_features(V.daily_bars(spark, d), [("open", "volume")], ("mul", "div")).select("symbol", "ts", "open_mul_volume", "open_div_volume"), 4)


@query(f'with {V.BARS} select symbol, ts, round(close * close, 2) as "close*close", round(close * volume, 2) as "close*volume", round(volume * volume, 2) as "volume*volume" from bars')
def sc5_polynomials(spark, d):
    return rounded(A.polynomial_features(V.daily_bars(spark, d), ["close", "volume"]).select("symbol", "ts", "close*close", "close*volume", "volume*volume"), 2)


@query(f"with {V.TICKS} select seq, round(price * (1 + sign(case when side = 'A' then -size else size end) * 0.1 * sqrt(size / 100)), 6) as moved from ticks")
def sc6_impact_price(spark, d):
    t = V.ticks(spark, d).withColumn("q", F.expr("case when side = 'A' then -size else size end"))
    return rounded(t.select("seq", A.impact_price(F.col("price"), F.col("q"), F.lit(100.0)).alias("moved")))


_CO = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as quantity, l_extendedprice / l_quantity as price, 0.2 as sigma, 1000.0 as volume, 0.1 as spread from lineitem"


def _costed(spark, d):
    return V.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity quantity", "l_extendedprice / l_quantity price", "0.2D sigma", "1000D volume", "0.1D spread", "lower(l_linestatus) side", "l_extendedprice / l_quantity * 0.99 ref_price")


_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(f"with c as ({_CO}), i as (select *, 0.5 * sigma / sqrt(252) * sqrt(quantity / volume) as impact, spread / (2 * price) as half_spread from c) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(impact, 6) as impact, round(half_spread, 6) as half_spread, round((impact + half_spread) * quantity * price, 6) as cost from i")
def sc7_sqrt_impact(spark, d):
    return rounded(A.sqrt_impact(_costed(spark, d)).select(*_ID, "impact", "half_spread", "cost"))


_AC = [f"quantity * {_SINH.format(f'0.6 * {1 - k / 4}')} / {_SINH.format('0.6')}" for k in range(5)]


@query(
    f"with c as ({_CO}), h as (select *, {', '.join(f'{x} as h{k}' for k, x in enumerate(_AC))} from c) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.5e-4 * quantity * quantity, 6) as permanent, "
    "round((pow(h0 - h1, 2) + pow(h1 - h2, 2) + pow(h2 - h3, 2) + pow(h3 - h4, 2)) * (1e-3 / 0.25), 6) as temporary, round(pow(sigma, 2) * 0.25 * (h1 * h1 + h2 * h2 + h3 * h3 + h4 * h4), 6) as variance from h"
)
def sc8_almgren_chriss(spark, d):
    return rounded(A.almgren_chriss(_costed(spark, d), 4, eta=1e-3, gamma=1e-4).select(*_ID, "permanent", "temporary", "variance"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def sc10_json_payload(spark, d):
    return A.decode_payload(V.table(spark, d, "events"), "k long", "props").select("event_id", "k")


@query(
    """with p as (
  select event_id, case when event_id % 10 = 0 then substr(props, 2)
    else json_object('k', cast(json_extract_string(props, '$.k') as bigint), 'who', json_object('id', user_id, 'tags', json_array(event_type, 'x')))::varchar end as t
  from events
)
select event_id, cast(json_extract_string(t, '$.k') as bigint) as k, cast(json_extract_string(t, '$.who.id') as bigint) as user_id,
  json_extract_string(t, '$.who.tags[0]') as tag
from (select event_id, case when json_valid(t) then t end as t from p)"""
)
def sc10_variant_payload(spark, d):
    """Nested payloads of no given schema, one in ten of them malformed."""
    nested = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.struct(F.col("user_id").alias("id"), F.array("event_type", F.lit("x")).alias("tags")).alias("who")))
    text = F.when(F.col("event_id") % 10 == 0, F.substring("props", 2, 1000)).otherwise(nested)
    rows = A.payload_variant(V.table(spark, d, "events").select("event_id", text.alias("payload")))
    found = {"k": ("$.k", "long"), "user_id": ("$.who.id", "long"), "tag": ("$.who.tags[0]", "string")}
    return rows.select("event_id", *(A.payload_value(path, kind).alias(c) for c, (path, kind) in found.items()))


@query(
    """select event_id, cast(p.pos as integer) as pos, case p.pos when 0 then 'k' else 'who' end as key,
  case p.pos when 0 then cast(cast(json_extract_string(props, '$.k') as bigint) as varchar) else '{"id":' || user_id || '}' end as value
from events, (select unnest([0, 1]) as pos) p"""
)
def sc10_variant_entries(spark, d):
    nested = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.struct(F.col("user_id").alias("id")).alias("who")))
    rows = A.payload_variant(V.table(spark, d, "events").select("event_id", nested.alias("payload")))
    return A.payload_entries(rows, ["event_id"])


_OPT = "opt as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as volume, cast(l_linenumber * 3 - 3 as double) as open_interest, l_extendedprice as premium, l_returnflag = 'R' and l_linenumber = 7 as is_sweep, false as is_block from lineitem)"


@query(f"with {_OPT}, r as (select *, coalesce(volume / nullif(open_interest, 0), 0) as vol_oi from opt) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(vol_oi, 6) as vol_oi, round(least(vol_oi / 3, 1), 6) as confidence from r where (vol_oi > 3 and premium > 50000) or is_sweep or is_block")
def sc11_unusual_options(spark, d):
    o = V.table(spark, d, "lineitem").selectExpr(*_ID, "l_quantity volume", "cast(l_linenumber * 3 - 3 as double) open_interest", "l_extendedprice premium", "l_returnflag = 'R' and l_linenumber = 7 is_sweep", "false is_block")
    return rounded(A.unusual_options(o).select(*_ID, "vol_oi", "confidence"))


@query(
    f"""with {V.TICKS}, q as (select seq, price - (size - 50) * 0.1 * 0.04 as r, greatest(0.1 * 0.04 + 20 * ln(1 + 0.1 / 1.5), price * 5 / 10000) as s from ticks)
 select seq, round(r, 6) as reservation, floor((r - s / 2) * 100 + 0.5) as bid_cents, floor((r + s / 2) * 100 + 0.5) as ask_cents from q"""
)
def sc12_maker_quotes(spark, d):
    q = A.maker_quotes(V.ticks(spark, d).selectExpr("seq", "price mid", "size - 50 inventory", "0.2D sigma"))
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("double").alias(c.replace("quote", "cents"))
    return q.select("seq", F.round(F.col("reservation") + 1e-9, 6).alias("reservation"), cents("bid_quote"), cents("ask_quote"))


@query("with f as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as q, l_extendedprice / l_quantity as p, case when l_returnflag = 'R' then -1 else 1 end as s from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(q * p, 4) as notional, round(q * p * 0.0005, 4) as commission, round(s * (p - p * 0.99) * q, 4) as slippage, round(q * p * 0.0005 + s * (p - p * 0.99) * q, 4) as total_cost from f")
def sc13_fill_costs(spark, d):
    f = _costed(spark, d).drop("side").join(V.table(spark, d, "lineitem").selectExpr(*_ID, "case when l_returnflag = 'R' then 'sell' else 'buy' end side", "l_quantity quantity", "l_extendedprice / l_quantity price"), [*_ID, "quantity", "price"])
    return rounded(A.fill_costs(f).select(*_ID, "notional", "commission", "slippage", "total_cost"), 4)


_NEEDLES = [("AAA", "Reth", 1), ("BBB", "ENST", 2), ("CCC", "keit", 3)]


@query(
    """with s as (select * from (values ('AAA', 'reth', 1), ('BBB', 'enst', 2), ('CCC', 'keit', 3)) t(symbol, needle, rank)), h as (select doc_id, symbol from documents join s on contains(lower(text), needle))
 select doc_id, symbol from h union all select doc_id, 'AAA' from documents where doc_id not in (select doc_id from h)"""
)
def jn11_tag_symbols(spark, d):
    s = spark.createDataFrame(_NEEDLES, "symbol string, needle string, rank int")
    return A.tag_symbols(V.table(spark, d, "documents"), s, key="doc_id")


_REC = f"{V.TICKS}, rec as (select symbol, ts, seq, price as value, size / 100 as confidence, case when side = 'B' then 'news' else 'flow' end as source, case when seq % 2 = 0 then 'a' else 'b' end as data_type from ticks)"


def _records(spark, d):
    return V.ticks(spark, d).selectExpr("symbol", "ts", "seq", "price value", "size / 100 confidence", "case when side = 'B' then 'news' else 'flow' end source", "case when seq % 2 = 0 then 'a' else 'b' end data_type")


@query(f"with {_REC}, w as (select symbol, value, confidence * exp(-0.693 * ((epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 3.6e9) / 240) as w from rec) select symbol, round(sum(value * w) / nullif(sum(w), 0), 6) as signal from w group by 1")
def ag36_composite_signal(spark, d):
    return rounded(A.composite_signal(_records(spark, d), "2024-01-31 00:00:00", 240.0))


@query(
    f"""with {_REC}, l as (select symbol, source || '_' || data_type as n, max_by(value, (ts, seq)) as v, max_by(confidence, (ts, seq)) as c from rec group by 1, 2)
 select symbol, round(max(case when n = 'news_a' then v end), 6) as alt_news_a, round(max(case when n = 'news_a' then c end), 6) as alt_news_a_confidence, round(max(case when n = 'flow_b' then v end), 6) as alt_flow_b, round(max(case when n = 'flow_b' then c end), 6) as alt_flow_b_confidence from l group by 1"""
)
def ag37_alt_features(spark, d):
    return rounded(A.alt_features(_records(spark, d), ["news_a", "flow_b"]))


@query("with i as (select 'negative' as issue, user_id as entity, case when value < 0 then 'FAIL' else 'PASS' end as status from events union all select 'small', user_id, case when value < 1 then 'WARN' else 'PASS' end from events) select issue, count(*) as n, count(distinct entity) as entities, case max(case status when 'FAIL' then 2 when 'WARN' then 1 else 0 end) when 2 then 'FAIL' when 1 then 'WARN' else 'PASS' end as status from i group by 1")
def ud2_custom_checks(spark, d):
    checks = [lambda t: t.selectExpr("'negative' issue", "symbol entity", "case when price < 0 then 'FAIL' else 'PASS' end status"), lambda t: t.selectExpr("'small' issue", "symbol entity", "case when price < 1 then 'WARN' else 'PASS' end status")]
    return B.recon_summary(I.run_checks(V.ticks(spark, d), checks))


def _turns(rows, state):
    """Where the price turns: rows between two that both lie below or both above; the last two prices are carried on."""
    import pyarrow as pa
    import pyarrow.compute as pc

    seq, price = (pa.chunked_array([*state[c], *rows.column(c).chunks]).combine_chunks() for c in ("seq", "price"))
    symbol = rows.column("symbol")[0].as_py()
    state["seq"], state["price"] = [seq[-2:]], [price[-2:]]
    if len(price) < 3:
        return None
    a, b, c = price[:-2], price[1:-1], price[2:]
    turn = pc.or_(pc.and_(pc.greater(b, a), pc.greater(b, c)), pc.and_(pc.less(b, a), pc.less(b, c)))
    found = pc.filter(seq[1:-1], turn)
    return pa.table({"symbol": pa.array([symbol] * len(found), pa.int64()), "seq": found})


@query(
    f"""with {V.TICKS}, n as (
  select symbol, seq, price, lag(price) over w as a, lead(price) over w as c from ticks window w as (partition by symbol order by ts, seq)
)
select symbol, seq from n where (price > a and price > c) or (price < a and price < c)"""
)
def ud1_feature_in_sql(spark, d):
    """A user's feature that SQL calls as a table function: turning points of each symbol."""
    Q.register_feature(spark, "turning_points", _turns, "symbol long, seq long", start=lambda: {"seq": [], "price": []})
    V.ticks(spark, d).selectExpr("cast(symbol as long) symbol", "ts", "cast(seq as long) seq", "price").createOrReplaceTempView("ticks_of_symbols")
    return spark.sql("select * from turning_points(table(ticks_of_symbols) partition by symbol order by (ts, seq))")


def _gap(rows, state):
    us = rows.column("us").to_numpy()
    past = us if state["last"] is None else [state["last"], *us]
    state["entity"] = str(rows.column("symbol")[0].as_py())
    state["most"] = max([state["most"], *(int(b - a) for a, b in zip(past, past[1:]))])
    state["last"] = int(us[-1])


@query(
    f"""with {V.TICKS}, g as (select symbol, epoch_us(ts) - lag(epoch_us(ts)) over (partition by symbol order by ts) as gap from ticks)
select 'gap' as issue, cast(symbol as varchar) as entity, case when coalesce(max(gap), 0) > 5 * 86400000000 then 'FAIL' else 'PASS' end as status
from g group by symbol"""
)
def ud2_check_in_sql(spark, d):
    """A user's check that SQL calls as a table function: symbols without a tick for over five days."""
    limit = 5 * 86_400_000_000
    finish = lambda s: [("gap", s["entity"], "FAIL" if s["most"] > limit else "PASS")]
    Q.register_check(spark, "long_gaps", _gap, finish, lambda: {"last": None, "most": 0, "entity": None})
    V.ticks(spark, d).selectExpr("cast(symbol as long) symbol", "unix_micros(cast(ts as timestamp)) us").createOrReplaceTempView("tick_times")
    return spark.sql("select * from long_gaps(table(tick_times) partition by symbol order by us)")
