"""Text quality by positive-unlabelled learning.

Trusted positives are rows labelled good; all other texts are unlabelled, whatever else is known of them.  A linear model on
features of a text's shape (pairs of neighbouring character classes, lengths, repetition) minimises the
non-negative unbiased risk with the logistic loss,

    prior E_P[l(f)] + max(0, E_U[l(-f)] - prior E_P[l(-f)]) + l2 |w|^2,

where the class prior is estimated from the same two samples: the share of unlabelled texts in a region, over that of positive
texts, is at least the prior and reaches it where there are no negatives, so its least value over regions of high score is taken.

Every sum over texts is a Spark job over all rows of the stored features; tasks add up their own rows, at most
32 tasks add those sums, and the driver sees 32 rows of fixed length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, slices, whole_text

#: Character classes by UTF-8 byte; bytes in none of them are class 0, those above 127 the last class.
CLASSES = (" \t", "\n\r", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?", "!", "'\"`-_", "()[]{}<>|/\\", "#$%&*+=@^~")
N_CLASSES = len(CLASSES) + 2
N_FEATURES = N_CLASSES * N_CLASSES + 9
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(CLASSES, 1):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[128:] = N_CLASSES - 1
BINS = 512


def text_features(texts: list[str]) -> np.ndarray:
    """One row for each text, of its whole length: square roots of the shares of class pairs, then lengths and repetition of words and lines."""
    out = np.zeros((len(texts), N_FEATURES))
    for row, text in zip(out, texts):
        codes = _CLASS[np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)]
        row[: N_CLASSES * N_CLASSES] = np.sqrt(np.bincount(codes[:-1] * N_CLASSES + codes[1:], minlength=N_CLASSES * N_CLASSES) / len(codes))
        words, lines = text.split(), text.split("\n")
        n = len(words)
        more = row[N_CLASSES * N_CLASSES :]
        if n:
            seen = np.fromiter(map(hash, words), np.int64, n)
            _, counts = np.unique(seen, return_counts=True)
            pairs = seen[:-1] * 1_000_003 ^ seen[1:]
            more[:6] = np.log1p(n) / 5, len(counts) / n, counts.max() / n, len(np.unique(pairs)) / max(n - 1, 1), (seen[1:] == seen[:-1]).sum() / max(n - 1, 1), sum(map(len, words)) / n / 10
            more[6] = np.log1p(max(map(len, words)))
        more[7:] = len(set(lines)) / len(lines), np.log1p(len(lines)) / 5
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, x) of each row: held_out is crc32(id) mod 3 = 1 (false for a null id), x the features as floats; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, 2000):
                x = text_features(texts[a:b]).astype(np.float32)
                offsets = pa.array(np.arange(b - a + 1) * N_FEATURES, pa.int32())
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["doc_id", "held_out", "x"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), whole_text(F.col(text_col)).alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, x array<float>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)


def total(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over all rows (x, positive) of part(matrix, positive), a vector of `width` numbers."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.slice(at, 4096)
                held += part(_matrix(own), own.column("positive").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                held += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["sums"])

    sums = rows.select("x", "positive").mapInArrow(local, "sums binary").repartition(32).mapInArrow(merge, "sums binary")
    return sum((np.frombuffer(r["sums"]) for r in sums.collect()), np.zeros(width))  # 32 rows


@dataclass
class QualityModel:
    """Weights of the standardised features (the last one is the constant) and the estimated class prior."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def decision(self, x: np.ndarray) -> np.ndarray:
        return _standard(x, self.mean, self.scale) @ self.weights


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _ridge(w: np.ndarray) -> np.ndarray:
    return np.concatenate([w[:-1], [0.0]])


def _curved(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, n_pos: int, n_all: int) -> tuple[np.ndarray, ...]:
    """At w: mean gradients of l(-f) over unlabelled and over positive rows, the positives' mean of x, and both Hessians."""
    d = len(w)

    def part(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        z = _standard(x, mean, scale)
        p = _sigmoid(z @ w)
        out = []
        for own in (~positive, positive):
            v, q = z[own], p[own]
            out += [v.T @ q, v.sum(0), ((v * (q * (1 - q))[:, None]).T @ v).ravel()]
        return np.concatenate(out)

    s = np.split(total(rows, part, 2 * (2 * d + d * d)), np.cumsum([d, d, d * d, d, d]))
    return s[0] / n_all, s[3] / n_pos, s[4] / n_pos, s[2].reshape(d, d) / n_all, s[5].reshape(d, d) / n_pos


def estimate_prior(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, n_pos: int, n_all: int, l2: float = 1e-2, steps: int = 12) -> float:
    """The share of positives among unlabelled rows: least ratio of the two samples' shares above a score.

    The score tells positives from unlabelled rows (logistic, both samples of equal weight).  It is fitted on the rows of one half
    (column `half`) and the shares are counted on the other one, in 512 bins, so that what it learns by heart does not count; each
    is moved by a standard error against the estimate, so that thin regions do not decide.
    """
    d = len(mean) + 1
    own, other = rows.filter("half = 0"), rows.filter("half = 1")
    w = np.zeros(d)
    for _ in range(steps):
        gu, gp, xp, hu, hp = _curved(own, mean, scale, w, max(n_pos / 2, 1), max(n_all / 2, 1))
        step = np.linalg.solve(hu + hp + 2 * l2 * np.eye(d), gu + gp - xp + 2 * l2 * _ridge(w))
        w = w - step
        if np.abs(step).max() < 1e-3:
            break

    def counted(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        at = np.clip(((np.clip(_standard(x, mean, scale) @ w, -8, 8) + 8) * BINS / 16).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at[own], minlength=BINS) for own in (~positive, positive)]).astype(float)

    unlabelled, positive = (np.cumsum(x[::-1]) for x in np.split(total(other, counted, 2 * BINS), 2))
    n_all, n_pos = max(unlabelled[-1], 1.0), max(positive[-1], 1.0)
    u, p = unlabelled / n_all + 1 / np.sqrt(n_all), positive / n_pos - 1 / np.sqrt(n_pos)
    return float(np.clip((u / np.maximum(p, 1e-9))[positive >= 0.1 * n_pos].min(), 0.01, 0.99))


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality", prior: float | None = None, l2: float = 1e-2, steps: int = 20) -> QualityModel:
    """The model from feature rows (see `features`; stored, as they are read some thirty times) and labels.

    Labels of rows that are held out are never read.  Positive is a row whose labels all are 1 (nulls left out); labels of 0
    count for nothing.  All other rows, and the positive ones once more, are unlabelled.  Newton steps
    along the unbiased risk are halved until the non-negative risk falls and its second part is not negative.  Without
    positives (or without any in one half, if the prior has to be estimated) every text scores 0.5.
    """
    good = labels.filter(f"doc_id is not null and {label_col} is not null").groupBy("doc_id").agg(F.min(label_col).alias("_y")).filter("_y = 1").select("doc_id")
    learning, half = rows.filter("not held_out"), F.pmod(F.xxhash64("doc_id"), F.lit(2))
    chosen = materialise(learning.join(good, "doc_id", "left_semi").select("x", half.alias("half")), "quality-positives")
    both = learning.select("x", half.alias("half"), F.lit(False).alias("positive")).unionByName(chosen.withColumn("positive", F.lit(True)))

    def moments(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        u = x[~positive]
        return np.concatenate([[len(u), positive.sum()], u.sum(0), (u * u).sum(0)])

    m = total(both, moments, 2 + 2 * N_FEATURES)
    n_all, n_pos = int(m[0]), int(m[1])
    mean = m[2 : 2 + N_FEATURES] / max(n_all, 1)
    scale = np.sqrt(np.maximum(m[2 + N_FEATURES :] / max(n_all, 1) - mean * mean, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)
    d = N_FEATURES + 1
    w = np.zeros(d)
    if not n_pos:
        return QualityModel(w, mean, scale, 0.5)
    prior = estimate_prior(both, mean, scale, n_pos, n_all) if prior is None else prior
    shares = 0.5 ** np.arange(11)

    def risks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """prior E_P[l(f)] and the part that must not be negative, at each column of weights."""
        k = at.shape[1]

        def part(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
            f = _standard(x, mean, scale) @ at
            return np.concatenate([_soft(f[~positive]).sum(0), _soft(f[positive]).sum(0), _soft(-f[positive]).sum(0)])

        u, p, q = np.split(total(both, part, 3 * k), 3)
        return prior * q / n_pos, u / n_all - prior * p / n_pos

    first, second = risks(w[:, None])
    best = first[0] + max(second[0], 0.0)
    for _ in range(steps):
        gu, _, xp, hu, _ = _curved(both, mean, scale, w, n_pos, n_all)
        step = np.linalg.solve(hu + 2 * l2 * np.eye(d), gu - prior * xp + 2 * l2 * _ridge(w))
        tried = w[:, None] - step[:, None] * shares[None, :]
        first, second = risks(tried)
        risk = first + np.maximum(second, 0) + l2 * (tried[:-1] ** 2).sum(0)
        fits = np.flatnonzero((second >= 0) & (risk < best - 1e-7))
        if not len(fits):
            break
        gain, best, w = best - risk[fits[0]], risk[fits[0]], tried[:, fits[0]]
        if gain < 1e-5:
            break
    return QualityModel(w, mean, scale, prior)


def score(rows: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of feature rows: score is the model's probability of good quality, predicted 1 from 0.5 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.slice(at, 4096)
                p = _sigmoid(model.decision(_matrix(own)))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`, by a model fitted on its rows that are not held out.

    Texts are read once and whole, of any length; a null or empty text has features as well and is scored; rows with a null id
    are unlabelled and scored; repeated rows stay; other columns are left out; an empty table gives an empty one.
    """
    rows = materialise(features(docs, id_col, text_col), "quality-features")
    return score(rows, fit(rows, labels))
