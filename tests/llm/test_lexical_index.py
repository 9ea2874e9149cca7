"""Ranked lexical search against a plain loop over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.llm import lexical_index as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(L.TERM, (text or "").translate(LOWER))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total, df = len(counted), sum(x for _, _, x in counted), Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        found = []
        for i, c, size in counted:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def test_terms():
    for text in ["Ab-c d_e", "É é ÀB9", "\0x\x7fy", "中文😀 a", "", " .", "a\nb\tC"]:
        assert [t.decode() for t in L.terms_of(text)] == terms(text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(2000)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(int(rng.paretovariate(0.9)) % 120))) for k in range(700)]
    docs += [(1000 + k, "same words w1 W2 w7") for k in range(90)]  # ties beyond the tenth
    docs += [(5000, None), (5001, ""), (5002, "... --"), (None, "same words w1 w2 w7"), (None, "w299"), (1000, "same words w1 w2 w7"), (6000, "w1 " * 40_000), (7000, "É é ÀB9 中文")]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for k in range(25)]
    items += [(100, None), (101, "absent terms"), (102, "w1 w1 W1"), (103, "w299 w5"), (103, "w7 same"), (None, "w3 É 中文"), (104, "same words")]
    return docs, items


def got(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_ranks_equal_brute_force(spark, rows):
    docs, items = rows
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({c: F.lit(1) for c in ("id", "term", "m", "score")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    want = sorted(brute(docs, items), key=repr)
    whole = L.build(d)
    assert got(L.search(whole, i)) == want
    # however the index is dealt, and in several blocks
    small = L.build(d, segment_docs=37, segment_chars=3000)
    assert small.rows.select("segment").distinct().count() > 15
    assert got(L.search(small, i)) == want
    assert got(L.search(small, i, block_terms=60)) == want
    assert got(L.search(whole, i, k=3)) == sorted(brute(docs, items, 3), key=repr)
    # postings stand by stratum and falling tf
    for r in small.rows.filter("term is not null").collect():
        assert r.df == len(r.docs) == sum(r.size) and list(zip(r.m, [-x for x in r.tf])) == sorted(zip(r.m, [-x for x in r.tf]))
        assert len(set(zip(r.m, r.tf))) == len(r.m)


def test_strata_below_the_bound_are_not_read():
    rng = np.random.default_rng(4)
    n = 4000
    m = np.sort(rng.integers(10, 400, n))
    ids = np.arange(n)
    rows, postings = [], 0
    for term in range(3):
        docs = np.flatnonzero(rng.random(n) < 0.3)
        rows.append((term, m[docs], np.ones(len(docs), np.int64), np.ones(len(docs), np.int64), docs))
        postings += len(docs)
    queries = L.Queries([1], np.array([0, 3]), np.arange(3), {}, np.array([500, 700, 900]))
    best = [L.Best(10)]
    read = L.search_segment(ids, m, rows, queries, best)
    scores = np.zeros(n, np.int64)
    for term, at, _, _, docs in rows:
        scores[docs] += queries.weights[term] * (1_000_000_000 // (1000 + 8 * at))
    order = np.lexsort((ids, -scores))[:10]
    assert list(best[0].docs) == list(order) and list(best[0].scores) == list(scores[order])
    assert read < postings / 10


def test_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows[0], "doc_id long, text string")
    items = spark.createDataFrame(rows[1], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("doc_id between 5000 and 5002"), items)):
        assert L.search(L.build(d), i).collect() == []
