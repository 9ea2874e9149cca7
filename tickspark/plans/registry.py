"""Queries by name, with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Added before rounding on both sides, so that exact halves fall the same way.
TIE = "1e-9"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("round(", f"round({TIE} + ")
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All double columns rounded, for comparison."""
    from pyspark.sql import functions as F

    return df.select(*(F.round(F.col(c) + float(TIE), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
