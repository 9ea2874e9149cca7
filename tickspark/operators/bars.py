"""Bars, grids, alignment, set operations and data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import BY, micros, ordered
from .clean import drop_duplicates, flag_outliers_z, interpolate_linear


def ticks_to_bars(ticks: DataFrame, interval: str = "1 hour", by=BY) -> DataFrame:
    """Left-closed bars: open, high, low, close, volume, vwap, trade_count; empty bars are absent."""
    key = F.struct("ts", "seq")
    out = ticks.groupBy(*by, F.window("ts", interval).alias("_w")).agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.sum("size").alias("volume"), (F.sum(F.col("price") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0.0))).alias("vwap"), F.count("*").alias("trade_count"),
    )
    return out.select(*by, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "vwap", "trade_count")


def regular_grid(df: DataFrame, interval: str, by=BY, ts: str = "ts") -> DataFrame:
    """Rows at each step from the first to the last time of a symbol, joined on the exact time, without filling."""
    ends = df.groupBy(*by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    grid = ends.select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"interval {interval}"))).alias(ts))
    return grid.join(df, [*by, ts], "left")


def resample(df: DataFrame, interval: str, keep_empty: bool = True, by=BY) -> DataFrame:
    """Bars re-binned to a longer interval by the usual rules; empty bins hold nulls and volume zero."""
    binned = df.groupBy(*by, F.window("ts", interval).alias("_w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    binned = binned.select(*by, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    if not keep_empty:
        return binned
    return regular_grid(binned, interval, by).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def align_by_time(frames: Sequence[DataFrame], keys: Sequence[str] = ("symbol", "ts"), how: str = "outer") -> DataFrame:
    """N-way join on the keys; a column that clashes gets the suffix of its frame's number."""
    out = frames[0]
    for i, right in enumerate(frames[1:], 1):
        for c in right.columns:
            if c not in keys and c in out.columns:
                right = right.withColumnRenamed(c, f"{c}_{i}")
        out = out.join(right, list(keys), how)
    return out


def gap_report(df: DataFrame, multiple: float = 5.0, by=BY, order=("ts", "seq")) -> DataFrame:
    """Gaps over `multiple` medians of a symbol's intervals (three rows at least): start, end, seconds, median."""
    seconds = (micros("ts") - micros(F.lag("ts").over(ordered(by, order)))) / 1e6
    steps = df.withColumns({"gap_start": F.lag("ts").over(ordered(by, order)), "seconds": seconds})
    stats = steps.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile("seconds", F.lit(0.5)).alias("median_seconds"))
    found = steps.join(stats, list(by)).filter((F.col("_n") >= 3) & (F.col("median_seconds") > 0) & (F.col("seconds") > multiple * F.col("median_seconds")))
    return found.select(*by, "gap_start", F.col("ts").alias("gap_end"), "seconds", "median_seconds")


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, rows in repeated keys, repeated keys, status (FAIL over 1 % of rows, WARN if any)."""
    counts = df.groupBy(*keys).count()
    many = F.col("count") > 1
    out = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(many, F.col("count"))), F.lit(0)).alias("duplicate_rows"), F.count(F.when(many, 1)).alias("duplicate_keys"))
    return out.withColumn("status", F.when(F.col("duplicate_rows") > 0.01 * F.col("n"), "FAIL").when(F.col("duplicate_rows") > 0, "WARN").otherwise("PASS"))


def outlier_report(df: DataFrame, col: str, method: str = "zscore", threshold: float = 4.0, by=BY) -> DataFrame:
    """Per symbol with ten rows and some spread: rows and outliers (z over the threshold, or three interquartile ranges)."""
    stats = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"), F.percentile(col, F.lit(0.25)).alias("_a"), F.percentile(col, F.lit(0.75)).alias("_b"))
    out = df.join(stats.filter("n >= 10 and _s > 0"), list(by))
    reach = 3 * (F.col("_b") - F.col("_a"))
    odd = F.abs(F.col(col) - F.col("_m")) > threshold * F.col("_s") if method == "zscore" else (F.col(col) < F.col("_a") - reach) | (F.col(col) > F.col("_b") + reach)
    return out.groupBy(*by).agg(F.first("n").alias("n"), F.count(F.when(odd, 1)).alias("outliers"))


def staleness_report(df: DataFrame, expected: DataFrame, max_seconds: float, as_of: str, by=BY) -> DataFrame:
    """Each expected symbol: its latest time and PASS, WARN (older than the limit at as_of) or FAIL (no rows)."""
    latest = df.groupBy(*by).agg(F.max("ts").alias("latest"))
    age = (micros(F.to_timestamp_ntz(F.lit(as_of))) - micros("latest")) / 1e6
    status = F.when(F.col("latest").isNull(), "FAIL").when(age > max_seconds, "WARN").otherwise("PASS")
    return expected.select(*by).distinct().join(latest, list(by), "left").withColumns({"age_seconds": age, "status": status})


def recon_summary(issues: DataFrame) -> DataFrame:
    """Per issue type: rows, entities and the worst of PASS, WARN, FAIL."""
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    out = issues.groupBy("issue").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), F.max(rank).alias("_r"))
    return out.withColumn("status", F.element_at(F.array(*map(F.lit, ("PASS", "WARN", "FAIL"))), F.col("_r") + 1)).drop("_r")


def heal(df: DataFrame, col: str, keys: list[str], order: list[str], by=BY, threshold: float = 4.0) -> DataFrame:
    """First row of each key, linear interpolation, then rows over the z-score threshold (sample deviation) dropped."""
    out = interpolate_linear(drop_duplicates(df, keys, order), [col], by, order)
    return flag_outliers_z(out, [col], threshold, by, sample=True).filter(~F.col(f"{col}_outlier")).drop(f"{col}_outlier")


def reconcile_sources(a: DataFrame, b: DataFrame, keys: list[str], value: str, tol: float = 0.01) -> DataFrame:
    """One row: counts, count status (FAIL if their difference is over tol of the larger, else WARN), matched keys, values that differ by more than tol."""
    n = a.agg(F.count("*").alias("n_a")).crossJoin(b.agg(F.count("*").alias("n_b")))  # one row each
    both = a.select(*keys, F.col(value).alias("_x")).join(b.select(*keys, F.col(value).alias("_y")), keys)
    differ = both.agg(F.count("*").alias("matched"), F.count(F.when(F.abs(F.col("_x") - F.col("_y")) > F.abs("_x") * tol, 1)).alias("value_breaks"))
    far = F.abs(F.col("n_a") - F.col("n_b")) / F.nullif(F.greatest("n_a", "n_b"), F.lit(0)) > tol
    return n.crossJoin(differ).withColumn("count_status", F.when(F.col("n_a") == F.col("n_b"), "PASS").when(far, "FAIL").otherwise("WARN"))


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def symbols_either(a: DataFrame, b: DataFrame, by=BY) -> DataFrame:
    return a.select(*by).union(b.select(*by)).distinct()


def common_timestamps(a: DataFrame, b: DataFrame, ts: str = "ts") -> DataFrame:
    return a.select(ts).intersect(b.select(ts))


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys, "left_anti")


def store_catalog(df: DataFrame, by=BY) -> DataFrame:
    return df.groupBy(*by).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def latest_per(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """The last n rows of each group in the given total order."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
