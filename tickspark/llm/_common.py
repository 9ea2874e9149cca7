"""Shared helpers: checkpoint folder, materialised tables, text access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders that materialise has written in this process and clear_scratch has not removed yet.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master, where it is unset, a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts lineage and is not computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickspark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """A mark for clear_scratch."""
    return len(_MADE)


def clear_scratch(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Removes the folders that materialise has written between two marks (now, if there is no second); results that are not yet written elsewhere can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    for path in _MADE[since:until]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del _MADE[since:until]


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def whole_text(column: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Jobs started inside pass rows to Python workers in batches of so many, for rows that hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside remove the files of their exchanges when they end; each must read stored tables and store its result, so that nothing is read twice from an exchange."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_HELD: dict[Any, Any] = {}


def worker_object(key: Any, build: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from task to task; it holds one at a time, so that a worker that goes on to another operator frees what the last one held."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def tasks_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_hot(rows: DataFrame, named: DataFrame, key: str | list[str], rows_of: str, most: int = 1000) -> DataFrame:
    """rows joined with `named` (one row for each key; column `rows_of` counts the key's rows) on the key, a column or several.

    Keys with more than 1/most of all rows, of which there are fewer than `most`, are sent to every task, so that no
    task gets all rows of one key; the others meet in a shuffle.  Both tables are read twice and should be stored.
    """
    total = named.agg(F.coalesce(F.sum(rows_of), F.lit(0)).alias("n")).first()["n"]
    hot, rest = named.filter(F.col(rows_of) * most > total).drop(rows_of), named.filter(F.col(rows_of) * most <= total).drop(rows_of)
    few = F.broadcast(hot)  # fewer than `most` rows
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(rest, key))


def slices(items: list[str], max_rows: int = 256, max_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs with at most so many rows and characters (one row at least)."""
    begin = chars = 0
    for k, x in enumerate(items):
        if k > begin and (k - begin >= max_rows or chars + len(x) > max_chars):
            yield begin, k
            begin, chars = k, 0
        chars += len(x)
    if begin < len(items):
        yield begin, len(items)
