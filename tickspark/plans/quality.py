"""Queries of cleaning, bars, alignment, set operations and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators import bars as B
from ..operators import clean as C
from ..sources import views as V
from .registry import query, rounded

_NULLED = "case when seq % 7 = 0 then null else price end"


def _gappy(spark, d):
    return V.ticks(spark, d).selectExpr("symbol", "ts", "seq", f"{_NULLED} as price")


@query("select user_id as symbol, ts, event_id as seq, value as price from events")
def cl1_conform(spark, d):
    schema = StructType([StructField("symbol", LongType()), StructField("seq", LongType()), StructField("price", DoubleType())])
    t = V.ticks(spark, d)
    return C.conform(t, StructType([schema[0], t.schema["ts"], schema[1], schema[2]]))


@query(f"with {V.QUOTES} select seq, not (price > 30) or not (volume >= 0) as bad from quotes where not (price > 0 and volume >= 0 and bid <= ask)")
def cl2_validate_records(spark, d):
    return C.validate_records(V.quotes(spark, d), "ticks")[1].selectExpr("seq", "not (price > 30) or not (volume >= 0) as bad")


@query("select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 6) as price from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) as n from lineitem) where n = 1")
def cl3_drop_duplicates(spark, d):
    out = C.drop_duplicates(V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price")))


@query(f"with {V.TICKS}, g as (select symbol, seq, {_NULLED} as price from ticks) select symbol, seq, round(coalesce(price, (select avg(price) from g)), 6) as price from g")
def cl4_fill_missing_mean(spark, d):
    return rounded(C.fill_missing(_gappy(spark, d), ["price"], "mean").select("symbol", "seq", "price"))


@query(f"with {V.TICKS}, g as (select symbol, seq, {_NULLED} as price from ticks) select symbol, seq, round(coalesce(price, (select median(price) from g)), 6) as price from g")
def cl4_fill_missing_median(spark, d):
    return rounded(C.fill_missing(_gappy(spark, d), ["price"], "median").select("symbol", "seq", "price"))


@query(
    f"""with {V.TICKS}, g as (select symbol, ts, seq, {_NULLED} as price, row_number() over (partition by symbol order by ts, seq) as r from ticks),
 f as (select *, last_value(price ignore nulls) over w as p, last_value(case when price is not null then r end ignore nulls) over w as pos from g
 window w as (partition by symbol order by ts, seq rows between unbounded preceding and current row))
 select symbol, seq, round(case when r - pos <= 1 then p end, 6) as price from f"""
)
def cl5_forward_fill(spark, d):
    return rounded(C.forward_fill(_gappy(spark, d), ["price"], max_gap=1).select("symbol", "seq", "price"))


@query(
    f"""with {V.TICKS}, g as (select symbol, ts, seq, {_NULLED} as price from ticks) select symbol, seq, round(first_value(price ignore nulls) over
 (partition by symbol order by ts, seq rows between current row and unbounded following), 6) as price from g"""
)
def cl5_backward_fill(spark, d):
    return rounded(C.forward_fill(_gappy(spark, d), ["price"], backward=True).select("symbol", "seq", "price"))


@query(
    f"""with {V.TICKS}, g as (select symbol, ts, seq, {_NULLED} as price, row_number() over (partition by symbol order by ts, seq) as r from ticks),
 f as (select *, last_value(price ignore nulls) over b as p0, last_value(case when price is not null then r end ignore nulls) over b as r0,
 first_value(price ignore nulls) over a as p1, first_value(case when price is not null then r end ignore nulls) over a as r1 from g
 window b as (partition by symbol order by ts, seq rows between unbounded preceding and current row),
 a as (partition by symbol order by ts, seq rows between current row and unbounded following))
 select symbol, seq, round(coalesce(price, case when p1 is null then p0 when p0 is not null then p0 + (p1 - p0) * (r - r0) / (r1 - r0) end), 6) as price from f"""
)
def cl6_interpolate(spark, d):
    return rounded(C.interpolate_linear(_gappy(spark, d), ["price"]).select("symbol", "seq", "price"))


@query(f"with {V.TICKS}, s as (select symbol, avg(price) as m, stddev_pop(price) as s from ticks group by 1) select symbol, seq, abs(price - m) > 3 * s as price_outlier from ticks join s using (symbol)")
def cl7_outliers_z(spark, d):
    return C.flag_outliers_z(V.ticks(spark, d), ["price"]).select("symbol", "seq", "price_outlier")


_IQR = "s as (select symbol, quantile_cont(price, 0.25) as a, quantile_cont(price, 0.75) as b from ticks group by 1)"


@query(f"with {V.TICKS}, {_IQR} select symbol, seq, price < a - 1.5 * (b - a) or price > b + 1.5 * (b - a) as price_outlier from ticks join s using (symbol)")
def cl8_outliers_iqr(spark, d):
    return C.flag_outliers_iqr(V.ticks(spark, d), ["price"]).select("symbol", "seq", "price_outlier")


@query(f"with {V.TICKS}, {_IQR} select symbol, seq, round(least(greatest(price, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 6) as price from ticks join s using (symbol)")
def cl9_cap_outliers(spark, d):
    return rounded(C.cap_outliers(V.ticks(spark, d), ["price"]).select("symbol", "seq", "price"))


@query(f"with {V.TICKS}, s as (select symbol, avg(price) as m, stddev_samp(price) as s from ticks group by 1) select symbol, seq, round((price - m) / nullif(s, 0), 6) as price from ticks join s using (symbol)")
def cl10_normalize_zscore(spark, d):
    return rounded(C.normalize(V.ticks(spark, d), ["price"]).select("symbol", "seq", "price"))


@query(f"with {V.TICKS}, s as (select symbol, median(price) as m, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) as s from ticks group by 1) select symbol, seq, round((price - m) / nullif(s, 0), 6) as price from ticks join s using (symbol)")
def cl10_normalize_robust(spark, d):
    return rounded(C.normalize(V.ticks(spark, d), ["price"], "robust").select("symbol", "seq", "price"))


@query(
    f"""with {V.BARS}, m as (select *, abs(close / nullif(lag(close) over (partition by symbol order by ts), 0) - 1) as ret from bars)
 select symbol, count(*) as n, cast(sum(case when open < 0 or high < 0 or low < 0 or close < 0 then 1 else 0 end) as bigint) as negative,
 round(sum(case when volume = 0 then 1 else 0 end) / count(*), 6) as zero_volume_share, sum(case when volume = 0 then 1 else 0 end) > 0.1 * count(*) as many_zero_volumes,
 cast(sum(case when low > least(open, close) or high < greatest(open, close) then 1 else 0 end) as bigint) as bad_bars,
 cast(sum(case when ret > 0.2 then 1 else 0 end) as bigint) as large_moves from m group by 1"""
)
def cl11_price_quality(spark, d):
    return rounded(C.price_quality_report(V.daily_bars(spark, d)))


@query(f"with {V.TICKS} select seq, ts from ticks where isodow(ts) < 6 and strftime(ts, '%H:%M:%S.%f') between '09:30:00' and '16:00:00.000000'")
def cl12_calendar(spark, d):
    return C.trading_calendar_filter(V.ticks(spark, d)).select("seq", "ts")


_HOURS = """select symbol, time_bucket(interval 6 hours, ts) as ts, first(price order by ts, seq) as open, max(price) as high, min(price) as low, first(price order by ts desc, seq desc) as close,
 sum(size) as volume, sum(price * size) / nullif(sum(size), 0) as vwap, count(*) as trade_count from ticks group by 1, 2"""


@query(f"with {V.TICKS}, b as ({_HOURS}) select symbol, ts, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume, round(vwap, 6) as vwap, trade_count from b")
def ag1_ticks_to_bars(spark, d):
    return rounded(B.ticks_to_bars(V.ticks(spark, d), "6 hours"))


@query(
    f"""with {V.TICKS}, b as ({_HOURS}), g as (select symbol, unnest(generate_series(min(time_bucket(interval 1 day, ts)), max(time_bucket(interval 1 day, ts)), interval 1 day)) as ts from b group by 1),
 r as (select symbol, time_bucket(interval 1 day, ts) as ts, first(open order by ts) as open, max(high) as high, min(low) as low, first(close order by ts desc) as close, sum(volume) as volume from b group by 1, 2)
 select g.symbol, g.ts, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, coalesce(volume, 0) as volume from g left join r on g.symbol = r.symbol and g.ts = r.ts"""
)
def ag2_resample(spark, d):
    return rounded(B.resample(B.ticks_to_bars(V.ticks(spark, d), "6 hours"), "1 day"))


@query(
    f"""with {V.TICKS}, s as (select symbol, lag(ts) over w as gap_start, ts as gap_end, (epoch_us(ts) - epoch_us(lag(ts) over w)) / 1e6 as seconds from ticks window w as (partition by symbol order by ts, seq)),
 m as (select symbol, count(*) as n, quantile_cont(seconds, 0.5) as med from s group by 1)
 select s.symbol, gap_start, gap_end, round(seconds, 6) as seconds, round(med, 6) as median_seconds from s join m on s.symbol = m.symbol where n >= 3 and med > 0 and seconds > 5 * med"""
)
def ag3_gap_report(spark, d):
    return rounded(B.gap_report(V.ticks(spark, d)))


@query(
    """with c as (select count(*) as n from lineitem group by l_orderkey, l_linenumber) select cast(sum(n) as bigint) as n, cast(sum(case when n > 1 then n else 0 end) as bigint) as duplicate_rows,
 cast(sum(case when n > 1 then 1 else 0 end) as bigint) as duplicate_keys, case when sum(case when n > 1 then n else 0 end) > 0.01 * sum(n) then 'FAIL' when sum(case when n > 1 then n else 0 end) > 0 then 'WARN' else 'PASS' end as status from c"""
)
def ag4_duplicate_report(spark, d):
    return B.duplicate_report(V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    f"""with {V.TICKS}, s as (select symbol, count(*) as n, avg(price) as m, stddev_samp(price) as s from ticks group by 1)
 select t.symbol, s.n, cast(sum(case when abs(price - m) > 3 * s then 1 else 0 end) as bigint) as outliers from ticks t join s on t.symbol = s.symbol where s.n >= 10 and s.s > 0 group by 1, 2"""
)
def ag5_outlier_report(spark, d):
    return B.outlier_report(V.ticks(spark, d), "price", threshold=3.0)


@query(
    f"""with {V.TICKS}, l as (select symbol, max(ts) as latest from ticks where seq % 3 <> 0 or symbol % 5 <> 0 group by 1), e as (select distinct symbol from ticks)
 select e.symbol, latest, round((epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(latest)) / 1e6, 6) as age_seconds,
 case when latest is null then 'FAIL' when (epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(latest)) / 1e6 > 86400 then 'WARN' else 'PASS' end as status from e left join l on e.symbol = l.symbol"""
)
def ag6_staleness(spark, d):
    t = V.ticks(spark, d)
    return rounded(B.staleness_report(t.filter("seq % 3 <> 0 or symbol % 5 <> 0"), t, 86400, "2024-01-31 00:00:00"))


@query(
    f"""with {V.TICKS}, i as (select 'size' as issue, symbol as entity, case when size = 0 then 'FAIL' else 'PASS' end as status from ticks
 union all select 'price', symbol, case when price < 1 then 'WARN' else 'PASS' end from ticks)
 select issue, count(*) as n, count(distinct entity) as entities, case max(case status when 'FAIL' then 2 when 'WARN' then 1 else 0 end) when 2 then 'FAIL' when 1 then 'WARN' else 'PASS' end as status from i group by 1"""
)
def ag7_recon_summary(spark, d):
    t = V.ticks(spark, d)
    a = t.selectExpr("'size' issue", "symbol entity", "case when size = 0 then 'FAIL' else 'PASS' end status")
    return B.recon_summary(B.union_sources([a, t.selectExpr("'price' issue", "symbol entity", "case when price < 1 then 'WARN' else 'PASS' end status")]))


@query(
    f"""with {V.TICKS}, g as (select symbol, ts, seq, {_NULLED} as price, row_number() over (partition by symbol order by ts, seq) as r from ticks),
 f as (select *, last_value(price ignore nulls) over b as p0, last_value(case when price is not null then r end ignore nulls) over b as r0,
 first_value(price ignore nulls) over a as p1, first_value(case when price is not null then r end ignore nulls) over a as r1 from g
 window b as (partition by symbol order by ts, seq rows between unbounded preceding and current row),
 a as (partition by symbol order by ts, seq rows between current row and unbounded following)),
 h as (select symbol, seq, coalesce(price, case when p1 is null then p0 when p0 is not null then p0 + (p1 - p0) * (r - r0) / (r1 - r0) end) as price from f),
 s as (select symbol, avg(price) as m, stddev_samp(price) as s from h group by 1)
 select symbol, seq, round(price, 6) as price from h join s using (symbol) where not coalesce(abs(price - m) > 4 * nullif(s, 0), false)"""
)
def ag8_heal(spark, d):
    return rounded(B.heal(_gappy(spark, d), "price", ["symbol", "ts", "seq"], ["ts", "seq"]).select("symbol", "seq", "price"))


@query(
    f"""with {V.BARS}, a as (select symbol, ts, close, volume from bars where symbol % 2 = 0), b as (select symbol, ts, close from bars where symbol % 3 = 0)
 select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.ts, b.ts) as ts, round(a.close, 6) as close, volume, round(b.close, 6) as close_1 from a full join b on a.symbol = b.symbol and a.ts = b.ts"""
)
def jn1_align(spark, d):
    b = V.daily_bars(spark, d)
    return rounded(B.align_by_time([b.filter("symbol % 2 = 0").select("symbol", "ts", "close", "volume"), b.filter("symbol % 3 = 0").select("symbol", "ts", "close")]))


@query(
    f"""with {V.BARS}, g as (select symbol, unnest(generate_series(min(ts), max(ts), interval 7 days)) as ts from bars group by 1)
 select g.symbol, g.ts, round(close, 6) as close from g left join bars b on g.symbol = b.symbol and g.ts = b.ts"""
)
def jn2_regular_grid(spark, d):
    return rounded(B.regular_grid(V.daily_bars(spark, d).select("symbol", "ts", "close"), "7 days"))


@query(
    f"""with {V.BARS}, a as (select * from bars), b as (select symbol, ts, case when symbol % 5 = 0 then close * 1.02 else close end as close from bars where symbol % 7 <> 0),
 j as (select a.close as x, b.close as y from a join b on a.symbol = b.symbol and a.ts = b.ts)
 select (select count(*) from a) as n_a, (select count(*) from b) as n_b, count(*) as matched, count(case when abs(x - y) > abs(x) * 0.01 then 1 end) as value_breaks,
 case when (select count(*) from a) = (select count(*) from b) then 'PASS' when abs((select count(*) from a) - (select count(*) from b)) / greatest((select count(*) from a), (select count(*) from b)) > 0.01 then 'FAIL' else 'WARN' end as count_status from j"""
)
def jn5_reconcile_sources(spark, d):
    b = V.daily_bars(spark, d).select("symbol", "ts", "close")
    other = b.filter("symbol % 7 <> 0").withColumn("close", F.expr("case when symbol % 5 = 0 then close * 1.02 else close end"))
    return B.reconcile_sources(b, other, ["symbol", "ts"], "close")


@query(f"with {V.TICKS} select symbol, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from ticks group by 1")
def io8_store_catalog(spark, d):
    return B.store_catalog(V.ticks(spark, d))


@query(f"with {V.TICKS} select symbol, seq from ticks where side = 'B' union all select symbol, seq from ticks where side = 'A'")
def so1_union_sources(spark, d):
    t = V.ticks(spark, d).select("symbol", "seq", "side")
    return B.union_sources([t.filter("side = 'B'"), t.filter("side = 'A'")]).select("symbol", "seq")


@query(f"with {V.TICKS} select symbol from ticks where side = 'B' union select l_suppkey from lineitem")
def so2_symbols_either(spark, d):
    return B.symbols_either(V.ticks(spark, d).filter("side = 'B'"), V.daily_bars(spark, d))


@query(f"with {V.BARS} select ts from bars where symbol % 2 = 0 intersect select ts from bars where symbol % 3 = 0")
def so3_common_timestamps(spark, d):
    b = V.daily_bars(spark, d)
    return B.common_timestamps(b.filter("symbol % 2 = 0"), b.filter("symbol % 3 = 0"))


@query("select o_orderkey as order_id from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def so4_only_in(spark, d):
    return B.only_in(V.orders_flow(spark, d), V.fills_internal(spark, d).filter("side = 'sell'"), ["order_id"]).select("order_id")


@query(f"with {V.TICKS} select symbol, side, seq from (select *, row_number() over (partition by symbol, side order by ts desc, seq desc) as n from ticks) where n <= 3")
def tk4_recent_events(spark, d):
    return B.latest_per(V.ticks(spark, d), ["symbol", "side"], ["ts", "seq"], 3).select("symbol", "side", "seq")
