"""Every registered query with SQL gives DuckDB's rows at the smallest scale."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tickspark.plans import all_queries, all_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return db


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return repr(float(v) + 0.0)
    if isinstance(v, (list, np.ndarray)):
        return str([cell(x) for x in v])
    return str(pd.Timestamp(v).as_unit("us")) if isinstance(v, (pd.Timestamp, np.datetime64)) else str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, con, small, name):
    ours, theirs = all_queries()[name](spark, small).toPandas(), con.execute(all_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
