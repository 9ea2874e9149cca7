"""Queries of sources and sinks, wire formats, model-facing work and streams; their input is written from the given tables first."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions.scratch import scratch_path
from ..functions.windows import micros
from ..operators import ml as M
from ..operators import technical as T
from ..sources import io as IO
from ..sources import records as R
from ..sources import views as V
from ..sources import wire as W
from ..streaming import ordered as O
from ..streaming import streams as S
from .analytics import positions_sql
from .registry import query, rounded

_CSV = "symbol long, ts timestamp_ntz, seq long, price double, size double, side string"


@query(f"with {V.TICKS} select symbol, ts, seq, round(price, 6) as price, side from ticks")
def io1_csv_round_trip(spark, d):
    path = scratch_path(spark, "csv")
    IO.write_table(V.ticks(spark, d), path, "csv")
    return rounded(IO.read_csv(spark, path, _CSV).select("symbol", "ts", "seq", "price", "side"))


@query(f"with {V.TICKS} select symbol, seq, round(price, 6) as price from ticks where symbol = 7 and ts between timestamp '2024-01-05' and timestamp '2024-01-20'")
def io2_read_ticks(spark, d):
    path = scratch_path(spark, "ticks")
    IO.write_partitioned(V.ticks(spark, d), path)
    return rounded(IO.read_ticks(spark, path, 7, "2024-01-05 00:00:00", "2024-01-20 00:00:00").selectExpr("cast(symbol as bigint) symbol", "seq", "price"))


@query(f"with {V.TICKS} select side, count(*) as n, round(sum(price * size), 4) as notional from ticks group by 1")
def io3_register_and_query(spark, d):
    return rounded(IO.register_and_query(spark, {"ticks_view": V.ticks(spark, d)}, "select side, count(*) n, sum(price * size) notional from ticks_view group by side"), 4)


@query(f"with {V.BARS} select symbol, ts, round(close, 6) as close, strftime(ts, '%Y-%m') as year_month from bars where ts >= timestamp '2002-01-01' - interval 730 days")
def io6_market_store(spark, d):
    path = scratch_path(spark, "store")
    IO.write_market_store(V.daily_bars(spark, d), path)
    out = IO.apply_retention(spark.read.parquet(path), 730, "2002-01-01 00:00:00")
    return rounded(out.select("symbol", "ts", "close", F.col("year_month").cast("string").alias("year_month")))


@query(f"with {V.TICKS} select symbol, seq, round(price, 6) as price, 'zstd' as codec from ticks")
def io4_write_table(spark, d):
    """Ticks written with a compression, which the files' names carry."""
    path = scratch_path(spark, "table")
    IO.write_table(V.ticks(spark, d), path, compression="zstd")
    codec = F.regexp_extract(F.col("_metadata.file_name"), r"\.(\w+)\.parquet$", 1).alias("codec")
    return rounded(spark.read.parquet(path).select("symbol", "seq", "price", codec))


@query(f"with {V.TICKS} select 'symbol=' || symbol as folder, count(*) as n, true as few_files from ticks group by 1")
def io5_write_partitioned(spark, d):
    """A folder for each symbol, in three files at most."""
    path = scratch_path(spark, "partitioned")
    IO.write_partitioned(V.ticks(spark, d), path, files=3)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(symbol=\w+)/[^/]+$", 1).alias("folder")
    rows = spark.read.parquet(path).select(folder, F.col("_metadata.file_name").alias("file"))
    return rows.groupBy("folder").agg(F.count("*").alias("n"), (F.countDistinct("file") <= 3).alias("few_files"))


@query(f"with {V.BARS} select symbol, ts, round(close, 6) as close from bars where ts >= timestamp '1996-03-17'")
def io6_retention(spark, d):
    """Whole months removed and the boundary month rewritten in the store itself."""
    path = scratch_path(spark, "store")
    IO.write_market_store(V.daily_bars(spark, d), path)
    IO.retain(spark, path, 366, "1997-03-18 00:00:00")
    return rounded(spark.read.parquet(path).select("symbol", "ts", "close"))


@query(f"with {V.BARS} select symbol, ts, round(close, 6) as close from bars where symbol in (1, 2, 3) and ts between timestamp '1996-01-01' and timestamp '1998-01-01'")
def io7_query_bars(spark, d):
    return rounded(IO.query_store(V.daily_bars(spark, d), [1, 2, 3], "1996-01-01 00:00:00", "1998-01-01 00:00:00").select("symbol", "ts", "close"))


@query(f"with {V.TICKS} select symbol, seq, 2 as depth, round(price - 0.02, 6) as second_bid from ticks where symbol in (1, 2) and ts between timestamp '2024-01-02' and timestamp '2024-01-25'")
def io7_query_book(spark, d):
    b = IO.query_book(T.book_from_ticks(V.ticks(spark, d)), [1, 2], "2024-01-02 00:00:00", "2024-01-25 00:00:00", depth=2)
    return rounded(b.select("symbol", "seq", F.size("bid_prices").alias("depth"), F.element_at("bid_prices", 2).alias("second_bid")))


_ADDED = """select l_orderkey as order_ref, case when l_returnflag = 'R' then 'S' else 'B' end as side, cast(l_quantity as bigint) as shares,
  'S' || l_suppkey as stock, round(cast(l_partkey as double) / 100, 6) as price
from lineitem"""


def _added(spark, d):
    """Add-order messages made from the fills."""
    hexed = lambda c, n: F.lpad(F.hex(F.col(c).cast("long")), n, "0")
    li = V.table(spark, d, "lineitem").withColumns({"us": F.unix_micros(F.col("l_shipdate").cast("timestamp")) % 86_400_000_000, "px": F.col("l_partkey") * 100})
    text = F.concat(
        F.lit("41"), hexed("us", 12), hexed("l_orderkey", 16), F.when(F.col("l_returnflag") == "R", "53").otherwise("42"), hexed("l_quantity", 8),
        F.hex(F.rpad(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), 8, " ")), hexed("px", 8), F.lit("00000000"),
    )
    return li.select(F.unhex(text).alias("data"))


@query(_ADDED)
def io12_decode_itch(spark, d):
    """Add-order messages made from the fills, decoded again."""
    return rounded(W.decode_itch(_added(spark, d)).select("order_ref", "side", "shares", "stock", "price"))


@query(_ADDED)
def io12_message_files(spark, d):
    """The same messages written as length-prefixed files, read in parallel ranges and decoded."""
    path = scratch_path(spark, "frames")
    R.write_frames(_added(spark, d), path)
    messages = R.read_frames(spark, path, max_length=64, range_bytes=65_536)
    return rounded(W.decode_itch(messages).select("order_ref", "side", "shares", "stock", "price"))


@query(
    f"""with {V.QUOTES}
select epoch_us(ts) * 1000 as ts_ns, round(price, 6) as price, round(bid, 6) as bid, round(ask, 6) as ask, cast(volume as bigint) as volume, 'Q' as side
from quotes where ts between timestamp '2024-01-05' and timestamp '2024-01-20'"""
)
def io11_fixed_ticks(spark, d):
    """Quotes written as files of 41-byte records in time order; a time range read back by ranges of 1,000 records."""
    path = scratch_path(spark, "records")
    q = V.quotes(spark, d).select((micros("ts") * 1000).alias("ts_ns"), "price", "bid", "ask", F.col("volume").cast("long"), F.lit("Q").alias("side"))
    R.write_fixed_ticks(q.sortWithinPartitions("ts_ns"), path)
    begin, end = (int(datetime(2024, 1, x, tzinfo=timezone.utc).timestamp()) * 1_000_000_000 for x in (5, 20))
    return rounded(R.read_fixed_ticks(spark, path, begin, end, records=1000, in_order=True))


_FIX = "concat('8=FIX.4.4', chr(1), '35=8', chr(1), '37=', l_orderkey, chr(1), '17=', l_linenumber, chr(1), '150=', case when l_returnflag = 'R' then '4' else 'F' end, chr(1), '55=', l_partkey, chr(1), '32=', cast(l_quantity as bigint), chr(1), '10=128', chr(1))"


def _fix(spark, d):
    return V.table(spark, d, "lineitem").selectExpr(f"{_FIX} message")


@query("select cast(l_orderkey as varchar) as order_id, cast(l_partkey as varchar) as symbol, l_quantity as last_qty, 0.0::double as last_px, l_returnflag <> 'R' as is_fill from lineitem")
def io13_decode_fix(spark, d):
    return W.decode_fix(_fix(spark, d)).select("order_id", "symbol", "last_qty", "last_px", "is_fill")


@query(f"with m as (select {_FIX} as message from lineitem), b as (select message, substr(message, 1, length(message) - 7) as body from m) select message, list_sum(list_transform(string_split(body, ''), lambda c: ascii(c))) % 256 = 128 as ok from b")
def io14_fix_checksum(spark, d):
    return _fix(spark, d).select("message", W.fix_checksum_ok(F.col("message")).alias("ok"))


@query(f"with {V.BARS} select symbol, ts, case when row_number() over w - 1 < floor(count(*) over (partition by symbol) * 0.7) then 'train' when row_number() over w - 1 < floor(count(*) over (partition by symbol) * (0.7::double + 0.15::double)) then 'valid' else 'test' end as part from bars window w as (partition by symbol order by ts)")
def ml1_time_split(spark, d):
    return M.time_split(V.daily_bars(spark, d)).select("symbol", "ts", "part")


@query(f"with {V.BARS} select symbol, ts, round((close - (select avg(close) from bars where ts < timestamp '1999-01-01')) / (select stddev_pop(close) from bars where ts < timestamp '1999-01-01'), 6) as close from bars")
def ml2_standard_scale(spark, d):
    b = V.daily_bars(spark, d)
    return rounded(M.standard_scale(b, ["close"], b.filter("ts < timestamp_ntz '1999-01-01 00:00:00'")).select("symbol", "ts", "close"))


@query(f"with {V.BARS}, x as (select symbol, ts, lag(close, 4) over w as first_close, close as last_close, lead(close) over w as target, row_number() over w as i from bars window w as (partition by symbol order by ts)) select symbol, ts, round(first_close, 6) as first_close, round(last_close, 6) as last_close, round(target, 6) as target from x where i >= 5 and target is not null")
def ml3_sequences(spark, d):
    s = M.sequences(V.daily_bars(spark, d), ["close", "volume"], 5, "close")
    return rounded(s.select("symbol", "ts", F.col("x")[0][0].alias("first_close"), F.col("x")[4][0].alias("last_close"), F.col("y")[0].alias("target")))


def _model_table(spark, d):
    b = T.forward_label(T.sma(T.returns(V.daily_bars(spark, d)), (5,)), 1)
    return b.select("symbol", "ts", "ret_1", "dist_sma_5", "volume", "label")


@query()
def ml4_fit_gbt(spark, d):
    """Importance of each feature and the fit of a boosted-tree model of the next return."""
    _, r2, weights = M.fit_gbt(_model_table(spark, d), ["ret_1", "dist_sma_5", "volume"], "label", maxIter=5, maxDepth=3)
    rows = spark.createDataFrame([(k, float(v), float(r2)) for k, v in weights.items()], "feature string, importance double, r2 double")
    return rounded(M.top_features(rows, 3))


_PRED = "pred as (select doc_id, cast(quality as double) as y, 0.5 + 0.3 * (doc_id % 3) / 2 as a, 0.2 + 0.6 * quality + 0.01 * (doc_id % 7) as b, doc_id % 4 as grp from labels)"


def _preds(spark, d):
    return V.table(spark, d, "labels").selectExpr("doc_id", "cast(quality as double) y", "0.5D + 0.3D * (doc_id % 3) / 2 a", "0.2D + 0.6D * quality + 0.01D * (doc_id % 7) b", "doc_id % 4 grp")


_W = "e as (select 1 / avg((a - y) * (a - y)) as a, 1 / avg((b - y) * (b - y)) as b from pred), w as (select a / (a + b) as wa, b / (a + b) as wb from e)"


@query(f"with {_PRED}, {_W} select 'a' as model, round(wa, 6) as weight from w union all select 'b', round(wb, 6) from w")
def ml5_ensemble_weights(spark, d):
    return rounded(M.ensemble_weights(_preds(spark, d), ["a", "b"], "y"))


@query(f"with {_PRED}, {_W} select doc_id, round(a * wa + b * wb, 6) as blended from pred, w")
def ml6_blend(spark, d):
    p = _preds(spark, d)
    return rounded(M.blend(p, M.ensemble_weights(p, ["a", "b"], "y"), ["a", "b"], "doc_id"))


@query(f"with {_PRED} select grp, round(covar_pop(b, y) / nullif(stddev_pop(b) * stddev_pop(y), 0), 6) as ic, count(*) as n from pred group by 1")
def ml7_information_coefficient(spark, d):
    return rounded(M.information_coefficient(_preds(spark, d), "b", "y", ["grp"]))


@query()
def ml8_kmeans_regimes(spark, d):
    return M.kmeans_regimes(_model_table(spark, d), ["ret_1", "dist_sma_5"]).select("symbol", "ts", "regime")


@query("select p_brand as name, max(p_partkey) as version, max_by(p_name, p_partkey) as uri from part where p_size % 3 = 0 group by 1")
def ml9_latest_model(spark, d):
    r = V.table(spark, d, "part").selectExpr("p_brand name", "p_partkey version", "p_name uri", "case when p_size % 3 = 0 then 'production' else 'staging' end stage")
    return M.latest_production_model(r)


# ---- streams


def _end(rows):
    """A row far in the future, without an id, in a file that is read last: it lets all others out."""
    late = {"ts": F.lit("2100-01-01 00:00:00").cast("timestamp")}
    return rows.limit(1).select(*(late.get(f.name, F.lit(-1 if f.name in ("symbol", "account") else None).cast(f.dataType)).alias(f.name) for f in rows.schema))


def _stream(spark, d, end=False):
    path = scratch_path(spark, "stream-in")
    V.ticks(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    if end:
        _end(spark.read.parquet(path)).write.mode("append").parquet(path)
    return S.stream_ticks(spark, path)


def _result(spark, stream, mode="append"):
    path, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    schema = stream.schema
    S.run_to_table(stream, path, checkpoint, mode)
    out = spark.read.schema(schema).parquet(path)
    return out.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in schema if f.dataType.simpleString() == "timestamp"})


_CLOSED = "<= (select max(ts) from ticks) - interval 10 minutes"


@query(
    f"""with {V.TICKS}, b as (select symbol, time_bucket(interval 6 hours, ts) as ts, first(price order by ts, seq) as open, max(price) as high, min(price) as low, first(price order by ts desc, seq desc) as close,
 sum(size) as volume, sum(price * size) / nullif(sum(size), 0) as vwap, count(*) as trade_count from ticks group by 1, 2) select symbol, ts, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume, round(vwap, 6) as vwap, trade_count from b where ts + interval 6 hours {_CLOSED}"""
)
def st2_stream_bars(spark, d):
    return rounded(_result(spark, S.stream_bars(_stream(spark, d), "6 hours")))


@query(
    f"""with {V.TICKS}, w as (select t.*, e from ticks t, (select unnest(generate_series(1, 4)) as k), lateral (select time_bucket(interval 6 hours, ts) + k * interval 6 hours as e)),
 g as (select symbol, e as ts, avg(price) as mean, count(*) as n, sum(size) as volume from w group by 1, 2) select symbol, ts, round(mean, 6) as mean, n, volume from g where ts {_CLOSED}"""
)
def st3_sliding_stats(spark, d):
    return rounded(_result(spark, S.stream_sliding_stats(_stream(spark, d), "24 hours", "6 hours")).select("symbol", "ts", "mean", "n", "volume"))


@query(f"with {V.TICKS} select symbol, seq, count(*) over w as n, round(avg(price) over w, 6) as price_mean, round(sum(size) over w, 6) as size_sum from ticks window w as (partition by symbol order by ts range interval 1 day preceding)")
def st4_trailing_features(spark, d):
    return rounded(_result(spark, O.stream_trailing_features(_stream(spark, d, end=True), 86400)).select("symbol", "seq", "n", "price_mean", "size_sum"))


@query(f"with {V.TICKS} select symbol, count(*) as n from ticks group by 1")
def st5_stream_dedup(spark, d):
    t = _stream(spark, d)
    return _result(spark, S.stream_dedup(t.unionByName(t), ["seq"], "40 days").select("symbol", "seq")).groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"with {V.TICKS}, v as (select symbol as entity_id, max_by(price, (ts, seq)) as value, max(ts) as ts from ticks group by 1) select entity_id, round(case when ts >= timestamp '2024-01-31' - interval 2 days then value end, 6) as value from v")
def st7_online_store(spark, d):
    path = scratch_path(spark, "online")
    stream = _stream(spark, d).selectExpr("symbol entity_id", "'price' feature_name", "price value", "ts")
    S.online_store_upsert(stream, path, scratch_path(spark, "online-state")).awaitTermination()
    return rounded(S.online_read(S.online_store(spark, path), "2024-01-31 00:00:00", 2 * 86400).select("entity_id", "value"))


@query(f"with {V.TICKS} select symbol as entity_id, ts, f as feature_name, round(case f when 'price' then price else size end, 6) as value from ticks, (select unnest(['price', 'size']) as f)")
def st8_write_features(spark, d):
    path = scratch_path(spark, "features")
    stream = _stream(spark, d).select(F.col("symbol").alias("entity_id"), "ts", F.create_map(F.lit("price"), "price", F.lit("size"), "size").alias("features"))
    S.stream_write_features(stream, path, scratch_path(spark, "features-state")).awaitTermination()
    return rounded(spark.read.schema("entity_id long, ts timestamp, feature_name string, value double").parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query(f"with {V.TICKS}, g as (select symbol as entity, time_bucket(interval 1 day, ts) + interval 1 day as ts, count(*) as n from ticks group by 1, 2) select entity, ts, n from g where n > 3 and ts {_CLOSED.replace('10 minutes', '1 minute')}")
def st9_risk_alerts(spark, d):
    orders = _stream(spark, d).withColumnRenamed("symbol", "entity")
    return _result(spark, S.stream_risk_alerts(orders, 3, "1 day", "1 day"))


def _fill_stream(spark, d, exchange: bool):
    path = scratch_path(spark, "fills-in")
    fills = (V.fills_exchange if exchange else V.fills_internal)(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).drop("account", "strategy", "k")
    fills.write.option("compression", "zstd").parquet(path)
    return spark.readStream.schema(fills.schema).option("maxFilesPerTrigger", 100).parquet(path)


@query(
    f"""with {V.FILLS} select i.fill_id as internal_id, x.fill_id as exchange_id from internal i join exchange x on i.order_id = x.order_id and i.symbol = x.symbol and i.side = x.side and i.venue = x.venue
 and x.ts between i.ts - interval 5 seconds and i.ts + interval 5 seconds"""
)
def st6_match_fills(spark, d):
    out = S.stream_match_fills(_fill_stream(spark, d, False), _fill_stream(spark, d, True), delay="4000 days")
    # columns that nobody reads need no place in the state
    return _result(spark, out.select("i_fill_id", "x_fill_id")).filter("i_fill_id is not null and x_fill_id is not null").selectExpr("i_fill_id internal_id", "x_fill_id exchange_id")


@query(
    f"""with recursive {positions_sql('(select * replace (symbol % 20 as symbol) from internal)')}
select fill_id, round(position, 4) as position, round(avg_cost, 4) as avg_cost, round(realized, 4) as realized from f"""
)
def st10_positions(spark, d):
    """Fills in files of no order, in two batches; the state puts them in order of event time."""
    path = scratch_path(spark, "fills-in")
    fills = V.fills_internal(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("symbol", F.col("symbol") % 20)
    cores = spark.sparkContext.defaultParallelism
    fills.repartition(3 * cores, "fill_id").write.parquet(path)
    _end(fills).write.mode("append").parquet(path)
    stream = spark.readStream.schema(fills.schema).option("maxFilesPerTrigger", 2 * cores).parquet(path)
    return rounded(_result(spark, O.stream_positions(stream, "4000 days")).select("fill_id", "position", "avg_cost", "realized"), 4)
