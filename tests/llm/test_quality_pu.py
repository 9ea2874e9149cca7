"""Positive-unlabelled quality: features, sums and risk against plain numpy, accuracy on rows that are held out, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.llm import quality_pu as Q


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def made(n=900, seed=5):
    """(id, text, good): junk of three kinds among plain prose."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        text, kind = words(rng, rng.randrange(20, 80)), rng.random()
        if kind < 0.08:
            text = "!! ".join(text.upper().split())
        elif kind < 0.16:
            text = "### ".join(text.split())
        elif kind < 0.24:
            text = " ".join([text.split()[0]] * 40)
        out.append((k, text, int(kind >= 0.24)))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(made(), "doc_id long, text string, good int")


def test_features_by_hand():
    x = Q.text_features(["", "ab ab\nAB 7", "é" * 9])
    assert x.shape == (3, Q.N_FEATURES) and np.isfinite(x).all()
    tail = x[1, Q.N_CLASSES**2 :]
    # four words, three kinds, one repeated at once; pairs (ab ab) (ab AB) (AB 7); two lines
    assert np.allclose(tail, [np.log1p(4) / 5, 3 / 4, 2 / 4, 1, 1 / 3, 7 / 4 / 10, np.log1p(2), 1, np.log1p(2) / 5])
    lower, space = 3, 1
    assert np.isclose(x[1, space * Q.N_CLASSES + lower] ** 2, 2 / 12) and np.isclose(x[1, lower * Q.N_CLASSES + lower] ** 2, 2 / 12)


def test_sums_and_gradients_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x, positive = rng.normal(size=(300, 5)).astype(np.float32), rng.random(300) < 0.4
    rows = spark.createDataFrame([(v.tolist(), bool(p)) for v, p in zip(x, positive)], "x array<float>, positive boolean").repartition(7)
    assert np.allclose(Q.total(rows, lambda m, p: np.concatenate([m[p].sum(0), m[~p].sum(0)]), 10), np.concatenate([x[positive].sum(0), x[~positive].sum(0)]), rtol=1e-6)
    mean, scale, w = np.zeros(5), np.ones(5), rng.normal(size=6)
    gu, gp, xp, hu, _ = Q._curved(rows, mean, scale, w, int(positive.sum()), int((~positive).sum()))
    z = Q._standard(x.astype(float), mean, scale)
    loss = lambda v: np.logaddexp(0, z[~positive] @ v).mean()
    for k in range(6):
        e = np.eye(6)[k] * 1e-5
        assert np.isclose(gu[k], (loss(w + e) - loss(w - e)) / 2e-5, atol=1e-6)
    p = 1 / (1 + np.exp(-(z[positive] @ w)))
    assert np.allclose(gp, z[positive].T @ p / positive.sum()) and np.allclose(xp, z[positive].mean(0))
    q = 1 / (1 + np.exp(-(z[~positive] @ w)))
    assert np.allclose(hu, (z[~positive] * (q * (1 - q))[:, None]).T @ z[~positive] / (~positive).sum())


def test_held_out_accuracy_and_labels_that_do_not_count(spark, table):
    docs, labels = table.select("doc_id", "text"), table.selectExpr("doc_id", "good quality")
    truth = {i: g for i, _, g in made()}
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [r for r in got.values() if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    # labels of held-out rows and labels of 0 change nothing
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))).filter("quality = 1 or doc_id % 2 = 0")
    again = {r.doc_id: r.score for r in Q.classify(docs, other).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in got.items())


def test_prior_and_risk(spark, table):
    rows = Q.materialise(Q.features(table), "t")
    model = Q.fit(rows, table.selectExpr("doc_id", "good quality"))
    assert 0.68 < model.prior < 0.95  # 0.76 in the data
    fixed = Q.fit(rows, table.selectExpr("doc_id", "good quality"), prior=0.76)
    x = np.array([r.x for r in rows.filter("not held_out").collect()])
    good = {i for i, _, g in made() if g}
    p = np.array([r.doc_id in good for r in rows.filter("not held_out").collect()])
    z = Q._standard(x, fixed.mean, fixed.scale)

    def risk(w):
        first, second = 0.76 * np.logaddexp(0, -z[p] @ w).mean(), np.logaddexp(0, z @ w).mean() - 0.76 * np.logaddexp(0, z[p] @ w).mean()
        return first + max(second, 0) + 1e-2 * (w[:-1] ** 2).sum(), second

    found, second = risk(fixed.weights)
    assert second >= -1e-9 and found < risk(np.zeros(len(fixed.weights)))[0] * 0.5


def test_odd_rows(spark, table):
    texts = [None, "", " \n", "é中文😀", "x" * 300_000, "a " * 200_000, "same", "same", "\0"]
    odd = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(texts)] + [(None, "no id"), (None, None), (10_006, "same")], "doc_id long, text string")
    docs = table.select("doc_id", "text").unionByName(odd).withColumns({c: F.lit("taken") for c in ("x", "score", "held_out", "half", "positive")})
    labels = table.selectExpr("doc_id", "good quality").unionByName(spark.createDataFrame([(None, 1), (10_001, None), (10_002, 0)], "doc_id long, quality int"))
    got = Q.classify(docs, labels).collect()
    assert len(got) == 900 + len(texts) + 3
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (10_006, 10_007)}) == 1
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    # no labels of good rows, and no rows
    none = Q.classify(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and len(none) == odd.count()
    assert Q.classify(odd.limit(0), labels).collect() == []
