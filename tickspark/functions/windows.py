"""Window specifications and the full-window guard."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

BY, ORDER = ("symbol",), ("ts", "seq")


def ordered(by=BY, order=ORDER) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def rows(n: int, by=BY, order=ORDER) -> WindowSpec:
    """The last n rows, the current one included."""
    return ordered(by, order).rowsBetween(1 - n, 0)


def running(by=BY, order=ORDER) -> WindowSpec:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, n: int, over: WindowSpec, agg=F.avg) -> Column:
    """agg over the window, null until it holds n non-null values."""
    return F.when(F.count(value).over(over) == n, agg(value).over(over))


def micros(ts: str | Column = "ts") -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (the session's zone is UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return a / F.when(b != 0, b)


def correlation(a: str | Column, b: str | Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of the pairs without nulls; null where one of them does not vary."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = F.when(b.isNotNull(), a).cast("double"), F.when(a.isNotNull(), b).cast("double")
    parts = F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)
    cov, sx, sy = (p.over(over) for p in parts) if over is not None else parts
    return cov / F.nullif(sx * sy, F.lit(0.0))
