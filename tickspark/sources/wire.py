"""Wire formats: binary order-book messages, tag=value messages.  Files of records and messages are in records.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Message lengths by type, and the place and kind of the fields after the common head (type, timestamp at 1, reference at 7).
LENGTHS = {"A": 36, "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35, "P": 44, "S": 12}


def decode_itch(df: DataFrame, col: str = "data") -> DataFrame:
    """Messages (one a row) -> (msg_type, ts_ns, order_ref, side, shares, stock, price, new_ref); unknown types and short messages go.

    Big-endian; six-byte nanoseconds at 1, reference at 7, prices in 1/10000.
    """
    m, kind = F.col("_m"), F.col("msg_type")
    number = lambda at, n: F.coalesce(F.conv(F.hex(F.substring(m, at + 1, n)), 16, 10).try_cast("long"), F.lit(0).cast("long"))
    letters = lambda at, n: F.substring(m, at + 1, n).cast("string")
    rows = df.select(F.col(col).alias("_m")).withColumn("msg_type", letters(0, 1))
    rows = rows.filter(kind.isin(*LENGTHS) & (F.octet_length(m) >= F.when(kind == "S", LENGTHS["S"]).otherwise(15)))
    add, taken = kind.isin("A", "F", "P"), kind.isin("E", "X", "C")
    return rows.select(
        "msg_type",
        number(1, 6).alias("ts_ns"),
        F.when(kind != "S", number(7, 8)).alias("order_ref"),
        F.when(add, letters(15, 1)).when(kind == "S", letters(7, 1)).alias("side"),
        F.when(add, number(16, 4)).when(taken, number(15, 4)).when(kind == "U", number(23, 4)).alias("shares"),
        F.when(add, F.trim(letters(20, 8))).alias("stock"),
        F.when(add | (kind == "C"), number(28, 4) / 10000).when(kind == "U", number(27, 4) / 10000).alias("price"),
        F.when(kind == "U", number(15, 8)).alias("new_ref"),
    )


SOH = "\u0001"


def decode_fix(df: DataFrame, col: str = "message") -> DataFrame:
    """Execution reports (35=8) with fills marked (150 in 1, 2, F); a missing number is 0."""
    m = F.str_to_map(F.col(col), F.lit(SOH), F.lit("="))
    tag = lambda k: F.try_element_at(m, F.lit(str(k)))
    number = lambda k: F.coalesce(F.expr(f"try_cast(try_element_at(_m, '{k}') as double)"), F.lit(0.0))
    out = df.withColumn("_m", m).filter(tag(35) == "8")
    return out.withColumns(
        {
            "order_id": tag(37), "exec_id": tag(17), "exec_type": tag(150), "symbol": tag(55), "fix_side": tag(54), "last_qty": number(32), "last_px": number(31),
            "is_fill": F.coalesce(tag(150).isin("1", "2", "F"), F.lit(False)),
        }
    ).drop("_m")


def fix_checksum(col: Column) -> Column:
    """Sum of the bytes before tag 10, modulo 256, in three digits."""
    body = F.regexp_extract(col, rf"(?s)^(.*{SOH})10=", 1)
    total = F.aggregate(F.transform(F.split(F.hex(F.encode(body, "UTF-8")), "(?<=\\G..)"), lambda h: F.coalesce(F.conv(h, 16, 10).cast("long"), F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.lpad((total % 256).cast("string"), 3, "0")


def fix_checksum_ok(col: Column) -> Column:
    return F.coalesce(fix_checksum(col) == F.regexp_extract(col, rf"{SOH}10=(\d{{3}})", 1), F.lit(False))
