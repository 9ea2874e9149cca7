"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features of a text are its lower-cased words and their prefixes of four to seven letters, each with
the value log(1 + count).  The cumulative-link (proportional odds) model has one weight vector
shared by all ordered thresholds: P(grade > k) = sigmoid(x w - theta_k), theta ascending, fitted by the likelihood of
the grades themselves, P(grade = k) = P(grade > k - 1) - P(grade > k).  The expected severity is the sum of P(grade > k).

Labels say toxic or not.  Toxic rows are graded 1 or 2 by how much marked features weigh in them; what is marked
for one half of the sample is found on the other half.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, slices, tasks_for, whole_text

_WORDS = re.compile(r"\w+").findall
PREFIXES = (4, 5, 6, 7)


@dataclass
class OrdinalModel:
    """Weights by feature and ascending thresholds; grades run from zero to their number."""

    weights: dict[str, float]
    thresholds: list[float]
    memo: dict[str, tuple] = field(default_factory=dict, repr=False, compare=False)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        eta = np.array([self.score(x) for x in texts], float).reshape(-1, 1)
        return 1 / (1 + np.exp(-np.clip(eta - np.array(self.thresholds)[None, :], -500, 500)))

    def score(self, text: str) -> float:
        if len(self.memo) > 150_000:
            self.memo = {}
        memo, found = self.memo, Counter()
        for word, n in Counter(_WORDS(text.lower())).items():
            hit = memo.get(word)
            if hit is None:
                hit = memo[word] = tuple(f for f in features(word) if f in self.weights)
            for f in hit:
                found[f] += n
        return float(sum(self.weights[f] * np.log1p(n) for f, n in found.items()))


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]


def _counts(text: str) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(_WORDS(text.lower())).items():
        for f in features(word):
            out[f] += n
    return out


def link_gradient(eta: np.ndarray, theta: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted negative log-likelihood of grades y, and its gradients by eta (each row) and theta."""
    rows, grades = np.arange(len(y)), len(theta)
    over = np.ones((len(y), grades + 2))  # P(grade > k) for k from -1 to the last grade
    over[:, 1:-1] = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta[None, :], -500, 500)))
    over[:, -1] = 0.0
    above, below = over[rows, y], over[rows, y + 1]
    p = np.maximum(above - below, 1e-12)
    by_theta = np.zeros((len(y), grades + 2))
    by_theta[rows, y] = above * (1 - above) / p
    by_theta[rows, y + 1] = -below * (1 - below) / p
    return float(-(weight * np.log(p)).sum()), -weight * (1 - above - below), (weight[:, None] * by_theta)[:, 1:-1].sum(0)


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, n_features: int, l2: float = 1.0, steps: int = 800, rate: float = 0.03, balance: float = 0.5):
    """Maximum penalised likelihood of the grades y by Adam, from the entries (rows, cols, vals) of the features; returns weights and ascending thresholds."""
    grades = int(y.max())
    w, theta = np.zeros(n_features), np.log([max((y <= k).mean(), 1e-3) / max((y > k).mean(), 1e-3) for k in range(grades)])
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(grades))
    weight = np.where(y > 0, max((y == 0).sum() / max((y > 0).sum(), 1), 1.0) ** balance, 1.0)
    m, v = np.zeros(n_features + grades), np.zeros(n_features + grades)
    for step in range(1, steps + 1):
        eta = np.bincount(rows, vals * w[cols], minlength=len(y))
        _, by_eta, by_theta = link_gradient(eta, theta, y, weight)
        g = np.concatenate([np.bincount(cols, vals * by_eta[rows], minlength=n_features) + l2 * w, by_theta]) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate / (1 + step / 200) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, theta = w - move[:n_features], theta - move[n_features:]
        theta = np.maximum.accumulate(theta + 1e-6 * np.arange(grades))
    return w, theta


def _z(a: str, b: str, n1: int, n0: int) -> Column:
    """z-score of document counts a of n1 toxic and b of n0 other rows."""
    pooled = (F.col(a) + F.col(b)) / F.lit(max(n1 + n0, 1))
    return (F.col(a) / max(n1, 1) - F.col(b) / max(n0, 1)) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * F.lit(1 / max(n1, 1) + 1 / max(n0, 1)))


def _document_counts(sample: DataFrame) -> DataFrame:
    """(feature, a0, b0, a1, b1): documents of each half with the feature, toxic (a) and other (b); tasks sum a bounded number of features before they pass them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, ...] = (Counter(), Counter(), Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(set().union(*held))
            columns = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in held)]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "a0", "b0", "a1", "b1"])

        for batch in batches:
            for text, toxic, half in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held[2 * half + (0 if toxic else 1)].update(_counts(text).keys())
                if sum(map(len, held)) > 200_000:
                    yield flush()
        yield flush()

    found = sample.select("text", "toxic", "half").mapInArrow(run, "feature string, a0 long, b0 long, a1 long, b1 long")
    return found.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("a0", "b0", "a1", "b1")))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, text_col: str = "text", max_features: int = 4000, least: float = 3.5) -> OrdinalModel:
    """Fits on a bounded sample: the `max_rows` labelled rows whose hashed id is least (ties by id).

    Features whose document counts differ between the classes by a z-score over `least`, at most `max_features`
    of them, are kept; the fit sees sparse vectors of those only, in one task.  The grade of a toxic row is 2 (severe) if its
    sum of log(1 + count) over marked features is over the toxic rows' median, else 1.  A row with several labels counts as toxic if any says so,
    a document that stands several times counts once by its least text; null ids and labels are left out, null texts
    are empty.  Without labels of both kinds nothing is rejected.
    """
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", F.col(text_col).alias("text")).filter("doc_id is not null").join(F.broadcast(chosen), "doc_id")
    once = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = once.repartition(tasks_for(docs.sparkSession), "doc_id").select(whole_text("text").alias("text"), "toxic", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int").alias("half"))
    sample = materialise(sample, "toxicity-sample")
    size = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}  # four rows
    n = lambda half, toxic: size.get((half, toxic), 0)
    if not n(0, 1) + n(1, 1) or not n(0, 0) + n(1, 0):
        return OrdinalModel({}, [1e3, 1e3])
    counts = materialise(_document_counts(sample), "toxicity-counts").withColumn("a", F.col("a0") + F.col("a1")).withColumn("b", F.col("b0") + F.col("b1"))

    def best(z: Column, seen: str) -> list[str]:
        ranked = counts.filter(F.expr(f"{seen} >= 3")).withColumn("z", z).filter(F.col("z") > least).orderBy(F.desc("z"), "feature")
        return [r["feature"] for r in ranked.limit(max_features).collect()]

    kept = best(_z("a", "b", n(0, 1) + n(1, 1), n(0, 0) + n(1, 0)), "a")
    # marks for a half come from the other one
    marks = [set(best(_z("a1", "b1", n(1, 1), n(1, 0)), "a1")), set(best(_z("a0", "b0", n(0, 1), n(0, 0)), "a0"))]
    if not kept:
        return OrdinalModel({}, [1e3, 1e3])
    place = {f: k for k, f in enumerate(kept)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked, cols, vals = [], [], []
            for text, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                found = _counts(text)
                hit = sorted((place[f], c) for f, c in found.items() if f in place)
                cols.append([k for k, _ in hit])
                vals.append(np.log1p([c for _, c in hit]))
                marked.append(float(sum(np.log1p(c) for f, c in found.items() if f in marks[half])))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(marked, pa.float64()), pa.array(cols, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float64()))], names=["toxic", "marked", "cols", "vals"])

    def run(data: pd.DataFrame) -> pd.DataFrame:
        toxic, marked = data["toxic"].to_numpy(int) > 0, data["marked"].to_numpy(float)
        grade = np.where(toxic, np.where(marked > np.median(marked[toxic]), 2, 1), 0)
        rows = np.repeat(np.arange(len(data)), [len(x) for x in data["cols"]])
        w, theta = fit_cumulative_link(rows, np.concatenate(data["cols"].to_list()).astype(int), np.concatenate(data["vals"].to_list()), grade, len(kept))
        return pd.DataFrame({"weights": [w.tolist()], "thresholds": [theta.tolist()]})

    sparse = sample.mapInArrow(vectors, "toxic int, marked double, cols array<int>, vals array<double>")
    fitted = sparse.withColumn("part", F.lit("all")).groupBy("part").applyInPandas(run, "weights array<double>, thresholds array<double>").first()
    return OrdinalModel(dict(zip(kept, fitted["weights"])), list(fitted["thresholds"]))


def add_severity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", at: float = 0.35, keep: str = "all") -> DataFrame:
    """The rows with p_toxic (P(grade > 0)), expected_severity and rejected (p_toxic >= at).

    Null text counts as empty; each row is rated on its own, so repeated rows and null ids stay; columns of those names
    are replaced.  keep="clean" returns only rows that are not rejected, with the columns of `docs` alone.
    """
    docs = docs if keep == "clean" else docs.drop("p_toxic", "expected_severity", "rejected")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(place).to_pylist()]
            p = np.concatenate([model.probabilities(texts[a:b]) for a, b in slices(texts)]) if texts else np.zeros((0, len(model.thresholds)))
            rejected = p[:, 0] >= at
            if keep == "clean":
                yield batch.filter(pa.array(~rejected))
            else:
                more = [pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "p_toxic", "expected_severity", "rejected"])

    schema = docs.schema
    if keep != "clean":
        schema = type(schema)(schema.fields[:]).add("p_toxic", "double").add("expected_severity", "double").add("rejected", "boolean")
    return docs.mapInArrow(run, schema)
