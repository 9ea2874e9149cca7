"""Word-piece counts of texts by a linear longest-match automaton.

The vocabulary is a trie with two roots (word-initial and continuing pieces).  Each node has a failure link
to the node of the longest suffix left after greedy pieces are cut off, with the number of pieces
that are cut off on the way; a word is then counted in one pass over its characters, without
backing up and without building the pieces.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, whole_text, worker_object
from .sp_model import MARK, NORMAL, read_model

_WORDS = re.compile(r"\w+|[^\w\s]").findall


class LongestMatch:
    """Greedy longest-match piece counts with the given word-initial and continuing pieces."""

    def __init__(self, initial: set[str], continuing: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.next[node].setdefault(c, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                        final.append(False)
                if piece:
                    final[node] = True
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if final[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], n

    def count(self, word: str) -> int:
        """The number of pieces, or -1 if a part has none (the word is then one unknown token)."""
        if not word:
            return 0
        node, n = 0, 0
        for c in word:
            while (step := self.next[node].get(c)) is None:
                n += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    return -1
            node = step
        while node != 1:
            n += self.popped[node]
            node = self.fail[node]
            if node < 0:
                return -1
        return n


def piece_sets(path: str) -> tuple[set[str], set[str]]:
    """Word-initial and continuing pieces of a vocabulary file that marks word starts."""
    normal = {p for p, _, kind in read_model(path).pieces if kind == NORMAL}
    return {p[1:] for p in normal if p[0] == MARK and MARK not in p[1:]} - {""}, {p for p in normal if MARK not in p}


def _worker(path: str) -> tuple[LongestMatch, dict[str, int]]:
    return worker_object(("automaton", path), lambda: (LongestMatch(*piece_sets(path)), {}))


def count_text(text: str, automaton: LongestMatch, memo: dict[str, int]) -> tuple[int, int, int]:
    """(words, tokens, unknown words); words are runs of word characters or single other characters."""
    words = tokens = unknown = 0
    for word, times in Counter(_WORDS(text)).items():
        n = memo.get(word)
        if n is None:
            n = automaton.count(word)
            if len(word) <= 64:
                memo[word] = n
        words += times
        if n < 0:
            unknown += times
            n = 1
        tokens += n * times
    return words, tokens, unknown


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of each row; null text counts as empty.

    Repeated rows and null ids stay; other columns are left out; an empty table gives an empty one; long texts are counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, memo = _worker(vocabulary)
        for batch in batches:
            texts, found = batch.column(1).to_pylist(), []
            for a, b in slices(texts):
                if len(memo) > 400_000:
                    memo.clear()
                found += [count_text(x, automaton, memo) for x in texts[a:b]]
            columns = np.array(found, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
