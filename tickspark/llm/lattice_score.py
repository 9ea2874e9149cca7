"""Document likelihood under a unigram piece model, summed over all segmentations.

The pieces and their scores come from a vocabulary file; where it has merge ranks instead of scores, or if asked for,
expectation steps over the training words turn them into probabilities.  A word's probability is the sum over all its
segmentations (log-space forward recursion over the lattice of pieces), a text's is the product over its words and one end.
The recursions run over many words of one length at once; the lattice's edges come from one table look-up
for all parts of one length.

Words are counted over the whole corpus.  Documents are read once, into blocks with a dictionary and a number of entries
of bounded size each; the dictionary rows, not the tokens, meet the word table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, whole_text
from .sp_model import BYTE, MARK, NORMAL, USER, SpModel, read_model

LN10 = math.log(10)


def initial_log_probs(model: SpModel) -> np.ndarray:
    """Log-probabilities of all pieces from the file's scores: those of a unigram model as they are, ranks by Zipf's law."""
    scores = np.array([s for _, s, _ in model.pieces], float)
    usable = np.array([kind in (NORMAL, USER, BYTE) for _, _, kind in model.pieces])
    if np.all(scores[usable] == np.round(scores[usable])):  # ranks
        scores = -np.log(2.0 + np.abs(scores))
        scores[[kind == BYTE for _, _, kind in model.pieces]] = -np.log(2.0 + len(scores))
    scores[~usable] = -np.inf
    top = scores.max()
    return scores - (top + math.log(np.exp(scores - top).sum()))


class Lattice:
    """Forward and backward recursions over the pieces of words, each led by the word-start mark."""

    LONG = 48  # longer words are taken one by one, in windows
    WINDOW = 1 << 16

    def __init__(self, model: SpModel, log_probs: np.ndarray):
        self.log_probs = log_probs
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER) and p}
        self.longest = max(map(len, self.ids), default=1)
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.unknown = float(log_probs[np.isfinite(log_probs)].min()) - 10.0
        self.times = np.uint64(0x9E3779B97F4A7C15)
        self._fill_table()

    def _fill_table(self) -> None:
        """Open addressing by 64-bit hashes of the pieces; slot zero of the ids stands for none."""
        pieces, codes = list(self.ids), {}
        for p in pieces:
            h = 0
            for c in p:
                h = ((h + ord(c) + 1) * int(self.times)) & (1 << 64) - 1
            codes[h] = self.ids[p]
        if len(codes) != len(pieces):
            raise ValueError("two pieces have one hash")
        bits = max(12, len(codes).bit_length() + 5)
        self.shift = np.uint64(64 - bits)
        self.keys, self.values, self.probes = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), 1
        for h, i in codes.items():
            at, n = (h ^ h >> 31) * 0xD6E8FEB86659FD93 % (1 << 64) >> 64 - bits, 1
            while self.values[at % (1 << bits)] >= 0:
                at, n = at + 1, n + 1
            self.keys[at % (1 << bits)], self.values[at % (1 << bits)] = h, i
            self.probes = max(self.probes, n)

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        at = ((h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)
        left = np.flatnonzero(self.values[at] >= 0)
        for _ in range(self.probes):
            place = at[left]
            hit = self.keys[place] == h[left]
            out[left[hit]] = self.values[place[hit]]
            left = left[~hit]
            at[left] = (at[left] + 1) % len(self.keys)
            left = left[self.values[at[left]] >= 0]
            if not len(left):
                break
        return out

    def _char(self, c: str) -> float:
        """A character without a piece of its own: its bytes, or a fixed penalty where the file has no byte pieces."""
        return sum(float(self.log_probs[self.byte_id[b]]) if b in self.byte_id else self.unknown for b in c.encode("utf-8", "surrogatepass"))

    def edges(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-probabilities, piece ids) by length and start: -inf and -1 where the part is no piece or longer than the room left in its word.

        A character without a piece has an edge of one with id -1.
        """
        n, spread = len(codes), codes.astype(np.uint64) + np.uint64(1)
        ids, h = np.full((self.longest, n), -1, np.int32), np.zeros(n, np.uint64)
        for k in range(min(self.longest, int(room.max(initial=0)))):
            h = (h[: n - k] + spread[k:]) * self.times
            ids[k, : n - k] = self._look_up(h)
            ids[k, room <= k] = -1
        lp = np.where(ids >= 0, self.log_probs[ids], -np.inf)
        bare = np.flatnonzero(ids[0] < 0)
        kinds, place = np.unique(codes[bare], return_inverse=True)
        lp[0, bare] = np.array([self._char(chr(c)) for c in kinds], float)[place]
        return lp, ids

    def _batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places of words, codes, starts, lengths) of words up to LONG, some 65,000 characters at a time, shortest first."""
        short = sorted((k for k, w in enumerate(words) if len(w) < self.LONG), key=lambda k: len(words[k]))
        at = 0
        while at < len(short):
            n = max(1, self.WINDOW // (len(words[short[at]]) + 1))
            part = short[at : at + n]
            sizes = np.array([len(words[k]) + 1 for k in part])
            yield np.array(part), _codes("".join([MARK + words[k] for k in part])), np.cumsum(sizes) - sizes, sizes
            at += n

    def _run(self, words: list[str], weights: np.ndarray | None, into: np.ndarray | None) -> np.ndarray:
        out = np.zeros(len(words))
        for places, codes, starts, sizes in self._batches(words):
            lp, ids = self.edges(codes, np.repeat(starts + sizes, sizes) - np.arange(len(codes)))
            passed = np.zeros(lp.shape) if into is not None else None
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                s = starts[own]
                alpha = self._forward(lp, s, size)
                out[places[own]] = alpha[-1]
                if passed is not None:
                    self._backward(lp, s, size, alpha, weights[places[own]], passed)
            if passed is not None:
                self._add(codes, ids, passed, into)
        for k, w in enumerate(words):
            if len(w) >= self.LONG:
                out[k] = self._long(_codes(MARK + w), float(weights[k]) if into is not None else 0.0, into)
        return out

    def _forward(self, lp: np.ndarray, s: np.ndarray, size: int) -> np.ndarray:
        alpha = np.zeros((size + 1, len(s)))
        for j in range(1, size + 1):
            ways = np.stack([alpha[i] + lp[j - i - 1, s + i] for i in range(max(0, j - self.longest), j)])
            alpha[j] = _log_sum(ways)
        return alpha

    def _backward(self, lp: np.ndarray, s: np.ndarray, size: int, alpha: np.ndarray, weight: np.ndarray, passed: np.ndarray) -> None:
        beta = np.zeros_like(alpha)
        for i in range(size - 1, -1, -1):
            ways = np.stack([lp[n - 1, s + i] + beta[i + n] for n in range(1, min(self.longest, size - i) + 1)])
            beta[i] = _log_sum(ways)
            passed[: len(ways), s + i] = weight * np.exp(np.minimum(ways + alpha[i] - alpha[-1], 0.0))

    def _add(self, codes: np.ndarray, ids: np.ndarray, passed: np.ndarray, into: np.ndarray) -> None:
        """Expected counts of pieces, and of the byte pieces of characters without one."""
        real = ids >= 0
        into += np.bincount(ids[real], passed[real], minlength=len(into))
        bare = np.flatnonzero((ids[0] < 0) & (passed[0] > 0))
        kinds, place = np.unique(codes[bare], return_inverse=True)
        for c, x in zip(kinds.tolist(), np.bincount(place, passed[0, bare], minlength=len(kinds)).tolist()):
            for b in chr(c).encode("utf-8", "surrogatepass"):
                if b in self.byte_id:
                    into[self.byte_id[b]] += x

    def _long(self, codes: np.ndarray, weight: float, into: np.ndarray | None) -> float:
        """One long word: its edges are made in windows, forward and then, for the counts, backward."""
        n = len(codes)
        alpha = np.full(n + 1, -np.inf)
        alpha[0] = 0.0

        def window(a: int):
            b = min(n, a + self.WINDOW)
            part = codes[a : min(n, b + self.longest)]
            lp, ids = self.edges(part, len(part) - np.arange(len(part)))
            return b, lp[:, : b - a], ids[:, : b - a]

        begins = range(0, n, self.WINDOW)
        for a in begins:
            b, lp, _ = window(a)
            for i in range(a, b):
                reach = min(self.longest, n - i)
                alpha[i + 1 : i + 1 + reach] = np.logaddexp(alpha[i + 1 : i + 1 + reach], alpha[i] + lp[:reach, i - a])
        if into is not None:
            beta = np.zeros(n + 1)
            for a in reversed(begins):
                b, lp, ids = window(a)
                passed = np.zeros(lp.shape)
                for i in range(b - 1, a - 1, -1):
                    reach = min(self.longest, n - i)
                    ways = lp[:reach, i - a] + beta[i + 1 : i + 1 + reach]
                    top = ways.max()
                    beta[i] = top + math.log(np.exp(ways - top).sum())
                    passed[:reach, i - a] = weight * np.exp(np.minimum(ways + alpha[i] - alpha[n], 0.0))
                self._add(codes[a:b], ids, passed, into)
        return float(alpha[n])

    def log_probs_of(self, words: list[str]) -> np.ndarray:
        """The log-probability of each word: the sum over all its segmentations."""
        return self._run(words, None, None)

    def expect(self, words: list[str], weights: np.ndarray, into: np.ndarray) -> None:
        """Adds the expected piece counts of the words, times their weights."""
        self._run(words, np.asarray(weights, float), into)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _log_sum(ways: np.ndarray) -> np.ndarray:
    top = ways.max(axis=0)
    return top + np.log(np.exp(ways - top).sum(axis=0))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves `fold`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


_BLOCKS = "kind int, block long, pos int, word binary, n_train long, doc_id long, held_out boolean, n_tokens long, at array<int>, times array<int>"


def _blocks(docs: DataFrame, max_words: int = 300_000, max_entries: int = 4_000_000) -> DataFrame:
    """Dictionary rows (kind 0: block, pos, word, n_train) and documents (kind 1: places in the dictionary and counts).

    A block ends when its dictionary or the entries of its documents pass their bounds.
    """
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = [x.split()[0] for x in _BLOCKS.split(", ")]

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        places: dict[bytes, int] = {}
        train, entries = np.zeros(1024, np.int64), 0

        def dictionary():
            words = list(places)
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                m = len(part)
                yield batch_of(m, kind=pa.array(np.zeros(m, np.int32)), block=pa.array(np.full(m, block)), pos=pa.array(np.arange(a, a + m, dtype=np.int32)), word=pa.array(part, pa.binary()), n_train=pa.array(train[a : a + m]))

        for batch in batches:
            ids, out_of, texts = (batch.column(k).to_pylist() for k in range(3))
            rows = []
            for name, out, text in zip(ids, out_of, texts):
                words = words_of(text)
                at = np.array([places.setdefault(w, len(places)) for w in words], np.int64)
                if len(places) > len(train):
                    train = np.concatenate([train, np.zeros(max(len(train), len(places)), np.int64)])
                at, times = np.unique(at, return_counts=True)
                if not out:
                    train[at] += times
                rows.append((block, name, out, len(words) + 1, at.astype(np.int32), times.astype(np.int32)))
                entries += len(at) + 1
                full = len(places) > max_words or entries > max_entries
                if full or len(rows) >= 500:
                    yield _doc_rows(rows, batch_of)
                    rows = []
                if full:
                    yield from dictionary()
                    block, places, train, entries = block + 1, {}, np.zeros(1024, np.int64), 0
            if rows:
                yield _doc_rows(rows, batch_of)
        if places:
            yield from dictionary()

    return docs.mapInArrow(run, _BLOCKS)


def _doc_rows(rows: list, batch_of) -> pa.RecordBatch:
    block, name, out, n, at, times = zip(*rows)
    m = len(rows)
    lists = {"at": at, "times": times}
    return batch_of(
        m, kind=pa.array(np.ones(m, np.int32)), block=pa.array(block, pa.int64()), doc_id=pa.array(name, pa.int64()), held_out=pa.array(out, pa.bool_()), n_tokens=pa.array(n, pa.int64()),
        **{k: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in v])]).astype(np.int32), np.concatenate(v)) for k, v in lists.items()},
    )


def _expected(words: DataFrame, model_path: str, log_probs: np.ndarray) -> np.ndarray:
    """Expected counts of all pieces over the training words; each task sums its own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, total = Lattice(read_model(model_path), log_probs), np.zeros(len(log_probs))
        for batch in batches:
            lattice.expect([bytes(w).decode("utf-8", "surrogatepass") for w in batch["word"]], batch["n"].to_numpy(float), total)
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids, "n": total[ids]})

    out = np.zeros(len(log_probs))
    for r in words.filter("n > 0").select("word", "n").mapInPandas(run, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).collect():  # as many as pieces
        out[r["id"]] = r["n"]
    return out


def fit_pieces(words: DataFrame, model_path: str, ends: int, rounds: int = 1, smooth: float = 0.1) -> tuple[np.ndarray, float]:
    """(log-probabilities of the pieces, that of the end), re-estimated over all training words."""
    model = read_model(model_path)
    log_probs = initial_log_probs(model)
    usable = np.isfinite(log_probs)
    for _ in range(rounds):
        found = np.where(usable, _expected(words, model_path, log_probs) + smooth, 0.0)
        total = found.sum() + ends + smooth
        with np.errstate(divide="ignore"):
            log_probs = np.log(found / total)
    return log_probs, math.log((ends + smooth) / total) if rounds else -math.log(len(log_probs))


def score(docs: DataFrame, model_path: str, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, log10.

    Null text counts as empty; rows with held_out false are the training part.  base_score is the add-half word
    unigram model; score the lattice model, after `rounds` expectation steps from the file's scores (none: as they are).
    Without any training row all counts are zero.  Repeated rows count as often as they stand; a null id counts as empty text when
    rows are held out; columns besides the id and the text are left out; an empty table gives an empty one.  Texts of any
    length are taken whole, as the distinct words of blocks; a word of any length is one lattice.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), whole_text(F.col(text_col)).alias("text"))
    blocks = materialise(_blocks(source), "word-blocks")
    entries = blocks.filter("kind = 0").select("block", "pos", "word", "n_train")
    words = materialise(entries.groupBy("word").agg(F.sum("n_train").alias("n")), "word-counts")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("v")).first()
    ends = blocks.filter("kind = 1 and not held_out").count()
    n_train, v = totals["n"] + ends, totals["v"] + (ends > 0)
    log_probs, end_lp = fit_pieces(words, model_path, ends, rounds)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(read_model(model_path), log_probs)
        for batch in batches:
            lp = lattice.log_probs_of([bytes(w).decode("utf-8", "surrogatepass") for w in batch["word"]])
            yield pd.DataFrame({"word": batch["word"], "n": batch["n"], "lp": lp})

    rated = words.mapInPandas(rate, "word binary, n long, lp double")
    looked = entries.drop("n_train").join(rated, "word").select(F.col("block").alias("_block"), "pos", "n", "lp")
    scale = math.log10(n_train + 0.5 * (v + 1))

    def join(key: tuple, texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("pos")
        n, lp = found["n"].to_numpy(np.int64), found["lp"].to_numpy(float)
        base = np.log10(n + 0.5) - scale
        out = []
        for at, times in zip(texts["at"], texts["times"]):
            at, times = np.asarray(at, np.int64), np.asarray(times, np.int64)
            out.append((int(times[n[at] > 0].sum()) + (ends > 0), float((times * base[at]).sum()) + math.log10(ends + 0.5) - scale, (float((times * lp[at]).sum()) + end_lp) / LN10))
        out = pd.DataFrame(out, columns=["n_known", "base_score", "score"])
        rest = texts[["doc_id", "held_out", "n_tokens"]].reset_index(drop=True)
        return pd.concat([rest, out], axis=1).assign(train_tokens=n_train)[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]]

    rows = blocks.filter("kind = 1").select("block", "doc_id", "held_out", "n_tokens", "at", "times")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(looked.groupBy("_block")).applyInPandas(join, schema)
