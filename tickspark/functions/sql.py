"""User-defined checks, features and aggregates that SQL calls: Arrow table functions by partition, and vectorised aggregates.

    register_check(spark, "stale", find_stale)
    spark.sql("select * from stale(table(ticks) partition by symbol order by ts)")
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

CHECK = "issue string, entity string, status string"


def partition_function(step: Callable[[pa.Table], Iterator[pa.Table] | None], schema: str, finish: Callable[[dict], pa.Table | None] | None = None, start: Callable[[], dict] | None = None):
    """An Arrow table function: step(table, state) for each batch of a partition's rows, finish(state) behind its last one.

    A partition's rows come in their ORDER BY; the state holds what is carried from batch to batch, so that a partition is
    never put together.
    """

    class Handler:
        def __init__(self):
            self.state = start() if start else {}
            self.seen = False

        def eval(self, batch):
            self.seen = True
            out = step(pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch, self.state)
            if out is not None:
                yield out

        def terminate(self):
            out = finish(self.state) if finish and self.seen else None
            if out is not None:
                yield out

    return F.arrow_udtf(Handler, returnType=schema)


def register_feature(spark: SparkSession, name: str, step: Callable, schema: str, start: Callable[[], dict] | None = None) -> None:
    """A feature for SQL: name(table(t) partition by ... order by ...) gives step(rows, state) of each batch."""
    spark.udtf.register(name, partition_function(step, schema, start=start))


def register_check(spark: SparkSession, name: str, step: Callable, finish: Callable[[dict], list[tuple[str, str, str]]], start: Callable[[], dict]) -> None:
    """A data check for SQL: step(rows, state) sees a partition's batches in order, finish(state) gives its (issue, entity, status) rows."""

    def table(state: dict) -> pa.Table:
        rows = finish(state)
        return pa.table({c: pa.array([r[k] for r in rows], pa.string()) for k, c in enumerate(("issue", "entity", "status"))})

    def quiet(rows: pa.Table, state: dict) -> None:
        step(rows, state)

    spark.udtf.register(name, partition_function(quiet, CHECK, table, start))


def register_aggregate(spark: SparkSession, name: str, f: Callable, kind: str = "double") -> None:
    """A vectorised aggregate for SQL: f(arrays of a group) -> value; null for an empty group is the function's own affair.

    A group's values meet in one task, as in any aggregate that has no partial form; large groups belong in built-in ones.
    """
    spark.udf.register(name, F.arrow_udf(f, kind, F.ArrowUDFType.GROUPED_AGG) if hasattr(F, "ArrowUDFType") else F.arrow_udf(f, kind))
