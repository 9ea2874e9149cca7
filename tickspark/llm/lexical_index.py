"""Ranked lexical search on a length-stratified index.

Documents are dealt into segments.  Inside a segment they stand by their length normaliser m; those with equal m form
a stratum, and a term's postings are kept by stratum and, within it, by falling tf.  The impact of a posting depends on (m, tf)
only, so it is computed once for each tf of a stratum, and the first posting of a stratum has the largest one: the sum of these over
an item's terms bounds every score in the stratum.  Strata are visited by falling bound until it is below the item's k-th score.

The index is a table of (segment, term) rows.  A search takes the rows of the items' terms only, brings those of one
segment together and streams through the segments of a task with the k best documents of each item at hand.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, whole_text

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = "segment long, term string, df int, m array<long>, tf array<long>, size array<int>, docs array<long>"
LAST = np.iinfo(np.int64).max


def terms_of(text: str) -> list[bytes]:
    """The terms in order, repeats included: runs of letters, digits and all that is not ASCII, only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


@dataclass
class Index:
    """`rows` holds (segment, term) postings and, with a null term, the ids and normalisers of a segment's documents."""

    rows: DataFrame
    documents: int
    terms: int


def _segment(number: int, ids: list, lengths: list[int], words: list[bytes], n_docs: int, n_terms: int) -> pa.RecordBatch:
    lookup: defaultdict[bytes, int] = defaultdict(count().__next__)
    code = np.fromiter(map(lookup.__getitem__, words), np.int64, len(words))
    n = np.array(lengths, np.int64)
    m = 10 + 90 * n * n_docs // n_terms
    rank = np.array([LAST if i is None else i for i in ids], np.int64)
    order = np.lexsort((rank, m))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    m = m[order]
    keys, tf = np.unique(code * len(n) + np.repeat(place, n), return_counts=True)
    term, doc = keys // len(n), keys % len(n)
    by = np.lexsort((doc, -tf, m[doc], term))
    term, doc, tf = term[by], doc[by], tf[by]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(m[doc]) != 0) | (np.diff(tf) != 0)]))
    names = list(lookup)
    ends = np.arange(len(names) + 1)
    doc_at, run_at = np.searchsorted(term, ends), np.searchsorted(term[first], ends)

    def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType, head: pa.Array) -> pa.Array:
        """The terms' lists behind the one of the documents' row."""
        offsets = np.concatenate([[0], at + len(head)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays([head, pa.array(values, kind)]))

    none = pa.array([], pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(names) + 1, number)),
            pa.array([None, *names], pa.binary()).cast(pa.string()),
            pa.array(np.concatenate([[len(n)], np.diff(doc_at)]), pa.int32()),
            lists(m[doc[first]], run_at, pa.int64(), pa.array(m)),
            lists(tf[first], run_at, pa.int64(), none),
            lists(np.diff(np.append(first, len(tf))), run_at, pa.int32(), pa.array([], pa.int32())),
            lists(doc, doc_at, pa.int64(), pa.array([ids[k] for k in order], pa.int64())),
        ],
        names=["segment", "term", "df", "m", "tf", "size", "docs"],
    )


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_docs: int = 2048, segment_chars: int = 4_000_000) -> Index:
    """The stored index of all rows with a term; null texts have none, every row is a document of its own, of any length.

    A segment ends with so many documents or characters.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(F.col(text_col)).alias("text"))
    n = F.regexp_count("text", F.lit(TERM)).cast("long")
    sums = source.select(n.alias("n")).filter("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        ids, lengths, words, size = [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = terms_of(text)
                if own:
                    ids.append(i)
                    lengths.append(len(own))
                    words += own
                    size += len(text)
                if len(ids) >= segment_docs or size >= segment_chars:
                    yield _segment(next(numbers), ids, lengths, words, n_docs, n_terms)
                    ids, lengths, words, size = [], [], [], 0
        if ids:
            yield _segment(next(numbers), ids, lengths, words, n_docs, n_terms)

    return Index(materialise(source.mapInArrow(run, INDEX), "lexical-index"), n_docs, n_terms)


@dataclass
class Queries:
    """A block of items: the numbers of their terms behind each other (item k has starts[k] to starts[k + 1]), and the terms' weights."""

    ids: list
    starts: np.ndarray
    numbers: np.ndarray
    place: dict[str, int]
    weights: np.ndarray


class Best:
    """The k best (score, document) of one item so far, ties to smaller ids."""

    __slots__ = ("docs", "k", "scores")

    def __init__(self, k: int):
        self.k, self.scores, self.docs = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """What a document needs at least to be among the k best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        keep = scores >= self.least()
        s, d = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.docs, docs[keep]])
        order = np.lexsort((d, -s))[: self.k]
        self.scores, self.docs = s[order], d[order]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all members of runs."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def search_segment(ids: np.ndarray, m: np.ndarray, rows: list[tuple], queries: Queries, best: list[Best]) -> int:
    """Puts the segment's documents into the items' best ones; rows are (term number, m, tf, size, docs).  Returns the number of postings read."""
    rows = sorted(rows, key=lambda r: r[0])
    if not rows:
        return 0
    strata, of_doc = np.unique(m, return_inverse=True)
    docs_in = np.bincount(of_doc)
    group_term = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
    group_m, tf, size = (np.concatenate([r[k] for r in rows]) for k in (1, 2, 3))
    # once for each tf of a stratum
    impact = queries.weights[group_term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * group_m))
    docs, impacts = np.concatenate([r[4] for r in rows]), np.repeat(impact, size)
    group_at = np.cumsum(size) - size
    stratum = np.searchsorted(strata, group_m)
    # a run: the postings of a term in a stratum; its first group has the largest tf
    first = np.flatnonzero(np.concatenate([[True], (np.diff(group_term) != 0) | (np.diff(stratum) != 0)]))
    run_stratum, run_bound, run_at = stratum[first], impact[first], group_at[first]
    run_size = np.diff(np.append(run_at, len(docs)))
    term_runs = np.searchsorted(group_term[first], np.arange(len(queries.weights) + 1))
    read = 0
    for k, held in enumerate(best):
        own = queries.numbers[queries.starts[k] : queries.starts[k + 1]]
        runs = _spread(term_runs[own], term_runs[own + 1] - term_runs[own])
        if not len(runs):
            continue
        bounds = np.bincount(run_stratum[runs], run_bound[runs], len(strata)).astype(np.int64)
        order = np.argsort(-bounds, kind="stable")
        at, most = 0, 4 * held.k
        while at < len(order) and bounds[order[at]] >= held.least():
            # so many strata at once that they hold `most` documents, each time more
            end = at + 1 + int(np.searchsorted(np.cumsum(docs_in[order[at:]]), most))
            visit = np.zeros(len(strata), bool)
            visit[order[at:end]] = bounds[order[at:end]] >= held.least()
            here = runs[visit[run_stratum[runs]]]
            postings = _spread(run_at[here], run_size[here])
            scores = np.bincount(docs[postings], impacts[postings], len(ids)).astype(np.int64)
            hit = np.flatnonzero(scores)
            held.add(scores[hit], ids[hit])
            read += len(postings)
            at, most = end, 8 * most
    return read


def _searched(rows: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in each task's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries.ids]
        now, ids, m, held = None, None, None, []
        for batch in batches:
            lists = [[batch.column(c)[i].values.to_numpy(zero_copy_only=False) for i in range(batch.num_rows)] for c in ("m", "tf", "size")]
            for i, (segment, term) in enumerate(zip(batch.column("segment").to_pylist(), batch.column("term").to_pylist())):
                docs = batch.column("docs")[i].values
                if segment != now:
                    if now is not None:
                        search_segment(ids, m, held, queries, best)
                    # a segment's documents come first
                    now, held = segment, []
                    ids, m = docs.fill_null(LAST).to_numpy(zero_copy_only=False), lists[0][i]
                else:
                    held.append((queries.place[term], lists[0][i], lists[1][i], lists[2][i], docs.to_numpy(zero_copy_only=False)))
        if now is not None:
            search_segment(ids, m, held, queries, best)
        if not best:
            return
        item = np.repeat(np.arange(len(best)), [len(b.docs) for b in best])
        docs, scores = (np.concatenate([getattr(b, c) for b in best]) for c in ("docs", "scores"))
        yield pa.RecordBatch.from_arrays([pa.array([queries.ids[x] for x in item], pa.int64()), pa.array(docs, mask=docs == LAST), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return rows.repartition("segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first()).mapInArrow(run, "item_id long, doc_id long, score long")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows that share an id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary()).cast(pa.string())], names=["item_id", "term"])

    source = items.select(F.col(id_col).cast("long"), whole_text(F.col(text_col)))
    return source.mapInArrow(run, "item_id long, term string").distinct()


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block_terms: int = 50_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item with a score over 0, equal scores by ascending id.

    Items are searched in blocks of about `block_terms` (item, term) rows (an item is never cut); a block's terms and
    weights go to every task, the index rows of its terms are read once for it.  Items or documents without terms give nothing; a document
    with a null id stands behind equal scores with one; documents that share an id are ranked each for itself; an item's rows and ranks
    do not depend on how the index is dealt.  Empty tables give no rows.
    """
    spark = index.rows.sparkSession
    wanted = materialise(item_terms(items, id_col, text_col), "lexical-items")
    blocks = max(1, math.ceil(wanted.count() / block_terms))
    out = None
    for number in range(blocks):
        own = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        queries, rows = _block(index, own)
        found = _searched(rows, queries, k)
        out = found if out is None else out.unionByName(found)
    ranked = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(index: Index, own: DataFrame) -> tuple[Queries, DataFrame]:
    """The items of a block with their terms' weights, and the index rows of these terms."""
    terms = own.select("term").distinct()
    rows = index.rows.join(F.broadcast(terms), "term", "left_semi")  # at most a block's terms
    df = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # at most a block's terms
    pairs = defaultdict(list)
    for r in own.collect():  # a block
        pairs[r["item_id"]].append(r["term"])
    names = sorted({t for x in pairs.values() for t in x})
    place = {t: j for j, t in enumerate(names)}
    weights = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df.get(t, 0) + 1))) for t in names], np.int64)
    ids = list(pairs)
    starts = np.cumsum([0, *(len(pairs[i]) for i in ids)])
    numbers = np.array([place[t] for i in ids for t in sorted(pairs[i])], np.int64)
    return Queries(ids, starts, numbers, place, weights), rows.unionByName(index.rows.filter("term is null"))
