"""Recall of the nearest-neighbour search on the given table where it prunes, and its exact setting."""

import os

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import DATA
from tickspark.llm.collision_search import nearest
from tickspark.llm.queries import op1_collision_counting


def brute(rows):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    out = {}
    for k in np.flatnonzero(ids % 20 == 0):
        s = v @ v[k]
        s[k] = -np.inf
        out[int(ids[k])] = [int(ids[j]) for j in np.lexsort((ids, -s))[:20]]
    return out


def test_recall_on_the_given_table(spark):
    sf = os.path.join(DATA, "sf0.1")
    want = brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    got = {}
    for r in op1_collision_counting(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert sum(len(got[q] & set(x)) for q, x in want.items()) / sum(map(len, want.values())) > 0.95


def test_exact_setting(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    got = {}
    for r in nearest(table, F.col("vec_id") % 20 == 0, share=1.0, block_rows=100).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want
