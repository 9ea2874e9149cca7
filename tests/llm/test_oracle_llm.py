"""Queries of this subpackage that have SQL give DuckDB's rows at the smallest scale."""

import duckdb
import pytest

from tests.test_oracle import TABLES, rows
from tickspark.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, small, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    ours, theirs = queries()[name](spark, small).toPandas(), db.execute(oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
