"""Market-data shapes over the given tables, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_type").isin("purchase", "signup"), "B").when(F.col("event_type").isin("click", "view"), "A").otherwise("T")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"), side.alias("side"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with a bid and an ask, and sizes at both."""
    t = ticks(spark, sf_dir)
    return t.select(
        "symbol", "ts", "seq", "price", F.col("size").alias("volume"), (F.col("price") - 0.01 * (1 + F.col("seq") % 3)).alias("bid"),
        (F.col("price") + 0.01 * (1 + F.col("seq") % 2)).alias("ask"), (F.col("size") + 1).alias("bid_size"), (100 - F.col("size")).alias("ask_size"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return (
        table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"))
        .agg(F.min_by(unit, key).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.max_by(unit, key).alias("close"), F.sum("l_quantity").alias("volume"))
    )


def fills_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint), cast(l_quantity as bigint)) fill_id",
        "l_orderkey order_id", "l_partkey symbol", "case when l_returnflag = 'R' then 'sell' else 'buy' end side", "l_quantity quantity",
        "l_extendedprice / l_quantity price", "l_linestatus venue", "l_shipdate ts", "l_suppkey account", "l_linenumber strategy",
        "pmod(l_orderkey * 31 + l_partkey, 97) k",
    )


def fills_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills_internal(spark, sf_dir).filter("k <> 0").selectExpr(
        "concat('x', fill_id) fill_id", "order_id", "case when k = 4 then symbol + 1000000 else symbol end symbol", "side", "case when k = 1 then quantity + 1 else quantity end quantity",
        "case when k = 2 then price * 1.05 else price end price", "venue", "case when k = 3 then ts + interval 5 seconds else ts end ts", "account", "strategy", "k",
    )


def orders_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey order_id", "o_custkey entity", "o_orderdate ts", "o_totalprice notional", "o_orderstatus status")


TICKS = """ticks as (select user_id as symbol, ts, event_id as seq, value as price, cast(json_extract_string(props, '$.k') as double) as size,
 case when event_type in ('purchase', 'signup') then 'B' when event_type in ('click', 'view') then 'A' else 'T' end as side from events)"""
QUOTES = TICKS + """, quotes as (select symbol, ts, seq, price, size as volume, price - 0.01 * (1 + seq % 3) as bid, price + 0.01 * (1 + seq % 2) as ask,
 size + 1 as bid_size, 100 - size as ask_size from ticks)"""
BARS = """bars as (select l_suppkey as symbol, l_shipdate as ts, first(l_extendedprice / l_quantity order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) as open,
 max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
 first(l_extendedprice / l_quantity order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_extendedprice desc, l_quantity desc) as close, sum(l_quantity) as volume
 from lineitem group by all)"""
RETURNS = BARS + ", returns as (select symbol, ts, close / lag(close) over (partition by symbol order by ts) - 1 as ret from bars)"
FILLS = """internal as (select concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint), cast(l_quantity as bigint)) as fill_id,
 l_orderkey as order_id, l_partkey as symbol, case when l_returnflag = 'R' then 'sell' else 'buy' end as side, l_quantity as quantity, l_extendedprice / l_quantity as price,
 l_linestatus as venue, l_shipdate as ts, l_suppkey as account, l_linenumber as strategy, (l_orderkey * 31 + l_partkey) % 97 as k from lineitem),
 exchange as (select concat('x', fill_id) as fill_id, order_id, case when k = 4 then symbol + 1000000 else symbol end as symbol, side, case when k = 1 then quantity + 1 else quantity end as quantity,
 case when k = 2 then price * 1.05 else price end as price, venue, case when k = 3 then ts + interval 5 seconds else ts end as ts, account, strategy, k from internal where k <> 0)"""
