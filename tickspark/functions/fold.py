"""Ordered folds: state that cannot be merged, carried row by row within each key.

Rows are dealt by key and sorted inside the partition, then read as one stream of batches, so a key of any
length needs only its state, and many short keys cost no call each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F  # noqa: F401


def same_key(a: tuple, b: tuple | None) -> bool:
    """Whether two keys are equal, nulls (None or NaN in pandas) equal to each other, as in a GROUP BY."""
    if a == b:
        return True
    return b is not None and all(x == y or (x is None or x != x) and (y is None or y != y) for x, y in zip(a, b))


def ordered_fold(df: DataFrame, by: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], inputs: list[str], fields: str) -> DataFrame:
    """Adds `fields` to each row: step(state, values of inputs) -> (state, outputs), from start() for each key; rows with a null key are one key."""
    names = [x.split()[0] for x in fields.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + fields

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, v in zip(batch[by].itertuples(index=False, name=None), batch[inputs].itertuples(index=False, name=None)):
                if not same_key(k, key):
                    key, state = k, start()
                state, row = step(state, v)
                out.append(row)
            yield pd.concat([batch, pd.DataFrame(out, columns=names, index=batch.index)], axis=1)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
