"""Cleaning: conforming, validation, duplicates, missing values, outliers, normalisation, calendars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.quantiles import exact_quantiles
from ..functions.windows import BY, ORDER, ordered, running

RULES = {
    "ticks": {"price": "price > 0", "volume": "volume >= 0", "crossed": "bid <= ask"},
    "bars": {"low": "low <= open and low <= close", "high": "open <= high and close <= high", "volume": "volume >= 0", "price": "low > 0"},
    "book": {"crossed": "bid_prices[0] < ask_prices[0]"},
    "trades": {"price": "price > 0", "quantity": "quantity > 0", "side": "lower(side) in ('buy', 'sell')"},
}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Selects and casts to a canonical schema; absent columns become null."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def validate_records(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with the array `reasons`); a rule over nulls counts as broken."""
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), name) for name, rule in RULES[kind].items())))
    marked = df.withColumn("reasons", reasons)
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def drop_duplicates(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """Keeps the first row of each key in the given total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*subset).orderBy(*order))).filter("_n = 1").drop("_n")


def fill_missing(df: DataFrame, cols: list[str], method: str = "mean") -> DataFrame:
    """drop: rows with a null go; mean or median: of the column."""
    if method == "drop":
        return df.dropna(subset=cols)
    if method == "mean":
        stats = df.agg(*(F.avg(c).alias(f"_{c}") for c in cols))
    else:
        # all columns at once, as the groups of one long table
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols))).alias("x")
        medians = exact_quantiles(df.select(cells).select("x.c", "x.v"), "v", {"m": 0.5}, ["c"])
        stats = medians.agg(*(F.max(F.when(F.col("c") == c, F.col("m"))).alias(f"_{c}") for c in cols))
    return df.crossJoin(F.broadcast(stats)).withColumns({c: F.coalesce(c, f"_{c}") for c in cols}).drop(*(f"_{c}" for c in cols))  # one row


def forward_fill(df: DataFrame, cols: list[str], max_gap: int | None = None, by=BY, order=ORDER, backward: bool = False) -> DataFrame:
    """The last (or next) value that is not null, over at most max_gap rows."""
    w = ordered(by, order)
    span = w.rowsBetween(0, Window.unboundedFollowing) if backward else w.rowsBetween(Window.unboundedPreceding, 0)
    pick = F.first if backward else F.last
    df = df.withColumn("_row", F.row_number().over(w))
    for c in cols:
        value = pick(F.col(c), ignorenulls=True).over(span)
        if max_gap is not None:
            at = pick(F.when(F.col(c).isNotNull(), F.col("_row")), ignorenulls=True).over(span)
            value = F.when(F.abs(F.col("_row") - at) <= max_gap, value)
        df = df.withColumn(f"_new_{c}", value)
    return df.withColumns({c: F.col(f"_new_{c}") for c in cols}).drop("_row", *(f"_new_{c}" for c in cols))


def interpolate_linear(df: DataFrame, cols: list[str], by=BY, order=ORDER) -> DataFrame:
    """Linear by row position; leading nulls stay, trailing ones take the last value."""
    w, after = ordered(by, order), ordered(by, order).rowsBetween(0, Window.unboundedFollowing)
    back = running(by, order)
    df = df.withColumn("_row", F.row_number().over(w))
    new = {}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.col("_row"))
        a, b = F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(after)
        i, j = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(after)
        new[f"_new_{c}"] = F.coalesce(c, F.when(b.isNull(), a).when(a.isNotNull(), a + (b - a) * (F.col("_row") - i) / F.nullif(j - i, F.lit(0))))
    df = df.withColumns(new)
    return df.withColumns({c: F.col(f"_new_{c}") for c in cols}).drop("_row", *new)


def _stats(df: DataFrame, cols: list[str], by, aggs: dict) -> DataFrame:
    """Per-group statistics joined to the rows (group-by and join, so a hot group is aggregated before)."""
    columns = [f(F.col(c)).alias(f"_{c}_{k}") for c in cols for k, f in aggs.items()]
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*columns)))  # one row
    stats = df.groupBy(*by).agg(*columns)
    return df.join(stats, list(by))


def _quantile(q: float):
    return lambda c: F.percentile(c, F.lit(q))


def flag_outliers_z(df: DataFrame, cols: list[str], threshold: float = 3.0, by=BY, sample: bool = False) -> DataFrame:
    """Adds <col>_outlier: the absolute z-score (population deviation unless `sample`) is over the threshold."""
    out = _stats(df, cols, by, {"m": F.avg, "s": F.stddev_samp if sample else F.stddev_pop})
    flags = {f"{c}_outlier": F.coalesce(F.abs(F.col(c) - F.col(f"_{c}_m")) > threshold * F.nullif(F.col(f"_{c}_s"), F.lit(0.0)), F.lit(False)) for c in cols}
    return out.withColumns(flags).drop(*(f"_{c}_{k}" for c in cols for k in "ms"))


def flag_outliers_iqr(df: DataFrame, cols: list[str], k: float = 1.5, by=BY) -> DataFrame:
    out = _stats(df, cols, by, {"a": _quantile(0.25), "b": _quantile(0.75)})
    reach = {c: k * (F.col(f"_{c}_b") - F.col(f"_{c}_a")) for c in cols}
    flags = {f"{c}_outlier": F.coalesce((F.col(c) < F.col(f"_{c}_a") - reach[c]) | (F.col(c) > F.col(f"_{c}_b") + reach[c]), F.lit(False)) for c in cols}
    return out.withColumns(flags).drop(*(f"_{c}_{x}" for c in cols for x in "ab"))


def cap_outliers(df: DataFrame, cols: list[str], method: str = "iqr", k: float = 1.5, low: float = 0.01, high: float = 0.99, by=BY) -> DataFrame:
    """Clips to the interquartile fence or to two quantiles."""
    p, q = (0.25, 0.75) if method == "iqr" else (low, high)
    out = _stats(df, cols, by, {"a": _quantile(p), "b": _quantile(q)})
    new = {}
    for c in cols:
        a, b = F.col(f"_{c}_a"), F.col(f"_{c}_b")
        reach = k * (b - a) if method == "iqr" else F.lit(0.0)
        new[c] = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), a - reach), b + reach))
    return out.withColumns(new).drop(*(f"_{c}_{x}" for c in cols for x in "ab"))


def normalize(df: DataFrame, cols: list[str], method: str = "zscore", by=BY) -> DataFrame:
    """zscore (sample deviation), minmax, or robust: (x - median) / interquartile range; zero spread gives null."""
    aggs = {
        "zscore": {"a": F.avg, "b": F.stddev_samp},
        "minmax": {"a": F.min, "b": lambda c: F.max(c) - F.min(c)},
        "robust": {"a": F.median, "b": lambda c: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))},
    }[method]
    out = _stats(df, cols, by, aggs)
    return out.withColumns({c: (F.col(c) - F.col(f"_{c}_a")) / F.nullif(F.col(f"_{c}_b"), F.lit(0.0)) for c in cols}).drop(*(f"_{c}_{x}" for c in cols for x in "ab"))


def price_quality_report(df: DataFrame, by=BY, order=("ts",)) -> DataFrame:
    """Per symbol: rows, negative prices, zero-volume share and whether it is over 10 %, bad bars, returns over 20 %."""
    last = F.lag("close").over(ordered(by, order))
    moved = df.withColumn("_ret", F.abs(F.col("close") / F.nullif(last, F.lit(0.0)) - 1))
    count = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    bad = (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close"))
    return moved.groupBy(*by).agg(
        F.count("*").alias("n"), count(reduce(lambda a, b: a | b, [F.col(c) < 0 for c in ("open", "high", "low", "close")])).alias("negative"),
        (count(F.col("volume") == 0) / F.count("*")).alias("zero_volume_share"), (count(F.col("volume") == 0) > 0.1 * F.count("*")).alias("many_zero_volumes"),
        count(bad).alias("bad_bars"), count(F.col("_ret") > 0.2).alias("large_moves"),
    )


def trading_calendar_filter(df: DataFrame, hours_only: bool = True, tz: str = "UTC", ts: str = "ts") -> DataFrame:
    """Weekdays and, if asked for, 09:30:00 to 16:00:00 inclusive in the zone."""
    local = F.col(ts).cast("timestamp") if tz == "UTC" else F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz)
    keep = F.weekday(local) < 5
    if hours_only:
        keep &= F.date_format(local, "HH:mm:ss.SSSSSS").between("09:30:00", "16:00:00.000000")
    return df.filter(keep)


def between_filter(column: Column, low, high) -> Column:
    return (column >= low) & (column <= high)
