"""SimHash near-duplicates with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each taken as a word of the
(23, 12, 7) Golay code.  If two fingerprints differ in at most four bits, either one segment is equal and another one
differs in at most two bits, so that their index sets have a member in common (keys of an equal segment and an index: 34 bits), or two
segments differ in exactly one bit each, so that the nearest codeword indices of one are among the one or six index values of
the other and both parities are opposite (keys of two indices and two parities: 26 bits).  Rows
are joined on those keys and verified; a pair counts only at the first kind of key it must share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, join_hot, materialise, slices, whole_text
from .components import connected_components
from .golay import decode, indices
from .shingle_hash import fingerprints

#: (shift, width) of the segments, and the pairs of them in the order of their kinds of keys.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
ORDERED = (*PAIRS, *((q, p) for p, q in PAIRS))
MAX_BITS = 4


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


MASKS = tuple(_signed(((1 << width) - 1) << shift) for shift, width in SEGMENTS)


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long) of each row; null text counts as empty, texts without words have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [fingerprints(texts[a:b], words) for a, b in slices(texts, 512, 2_000_000)]
            fp = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(F.col(text_col)).alias("text"))
    return source.mapInArrow(run, "id long, fp long")


def _keys(fp: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of its fingerprint) rows: a key holds its kind above bit 36."""
    words = [((fp.view(np.uint64) >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    near = [decode(x) for x in words]
    sets = [indices(x) for x in words]
    odd = [(np.bitwise_count(x).astype(np.int64) & 1) ^ probe for x in words]
    keys, owners = [], []
    every = np.arange(len(fp))
    for kind, (p, q) in enumerate(PAIRS):
        head = (kind << 36) | (odd[p] << 25) | (odd[q] << 24)
        if probe:
            for i in range(6):
                for j in range(6):
                    ok = (sets[p][:, i] >= 0) & (sets[q][:, j] >= 0)
                    keys.append(head[ok] | (sets[p][ok, i] << 12) | sets[q][ok, j])
                    owners.append(every[ok])
        else:
            keys.append(head | (near[p] << 12) | near[q])
            owners.append(every)
    for kind, (p, q) in enumerate(ORDERED, len(PAIRS)):
        for i in range(6):
            ok = sets[p][:, i] >= 0
            keys.append((kind << 36) | (sets[p][ok, i] << 22) | words[q][ok])
            owners.append(every[ok])
    return np.concatenate(keys), np.concatenate(owners)


def _key_rows(prints: DataFrame, probe: bool) -> DataFrame:
    """(key, fp, root) rows of (fp, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, root = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at in range(0, len(fp), 2000):
                key, owner = _keys(fp[at : at + 2000], probe)
                columns = (key, fp[at + owner], root[at + owner])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "fp", "root"])

    return prints.select("fp", "root").mapInArrow(run, "key long, fp long, root long")


def _kind(x: str) -> str:
    """SQL: the first kind of key that fingerprints with difference x must share."""
    bits = [f"bit_count({x} & {m}L)" if m > -(1 << 63) else f"bit_count({x} & (-9223372036854775807L - 1L))" for m in MASKS]
    cases = [f"when {bits[p]} = 1 and {bits[q]} = 1 then {k}" for k, (p, q) in enumerate(PAIRS)]
    cases += [f"when {bits[p]} <= 2 and {bits[q]} = 0 then {k}" for k, (p, q) in enumerate(ORDERED, len(PAIRS))]
    return f"case {' '.join(cases)} else -1 end"


def near_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): all pairs a < b of the distinct fingerprints `fp` that differ in at most four bits, but for those with one `root`.

    Without a column root, every fingerprint is its own.  Fingerprints first meet the roots that share a key with them and
    then those roots' members, so that no two of one root are ever paired.
    """
    if "root" not in prints.columns:
        prints = prints.select("fp", F.col("fp").alias("root"))
    left = _key_rows(prints, probe=False)
    roots = left.select("key", F.col("root").alias("other")).distinct()
    # merge joins: the planner takes the keys' tables for as small as the fingerprints' and would broadcast them
    met = _key_rows(prints, probe=True).join(roots.hint("merge"), "key").filter("root <> other").select("key", F.col("fp").alias("near"), F.col("other").alias("root"))
    x = "(fp ^ near)"
    pairs = met.join(left.hint("merge"), ["key", "root"]).filter(f"bit_count({x}) <= {MAX_BITS} and shiftright(key, 36) = {_kind(x)}")
    return pairs.select(F.least("fp", "near").alias("a"), F.greatest("fp", "near").alias("b")).distinct()


def star_links(prints: DataFrame) -> DataFrame:
    """(a, b): verified links of fingerprints to the least fingerprint of each of their keys; as many as keys at most."""
    own = prints.select("fp", F.col("fp").alias("root"))
    least = _key_rows(own, probe=False).groupBy("key").agg(F.min("fp").alias("a"))
    met = _key_rows(own, probe=True).join(least.hint("merge"), "key").filter(f"a <> fp and bit_count(a ^ fp) <= {MAX_BITS}")
    return met.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()


def component_roots(prints: DataFrame) -> DataFrame:
    """(node, root) of the linked fingerprints.

    Links to the least member of each key join the dense clouds first, so that the pairs which are then
    looked for are only those between different parts: a cloud does not yield all its pairs.
    """
    stars = checkpoint(star_links(prints))
    parts = connected_components(stars)
    marked = prints.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return connected_components(stars.unionByName(near_pairs(marked)))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """One row per row of `docs`: id, fp (long), component_id.

    component_id is the smallest id reachable over links of at most four differing bits.  Rows with
    a null id are linked too but never name a group (null if no row of the group has an id).
    Equal fingerprints meet as one; pairs arise only between different ones.  Null text counts as empty, texts without words
    are linked to each other; repeated rows stay; columns besides the id and the text are left out; an empty table gives an empty one.
    """
    marked = materialise(add_fingerprints(docs, id_col, text_col, words), "fingerprints")
    prints = materialise(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "prints")
    roots = checkpoint(component_roots(prints.select("fp")))
    linked = roots.withColumnRenamed("node", "fp").join(prints, "fp")
    groups = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = roots.join(groups, "root").select(F.col("node").alias("fp"), "component_id")
    named = prints.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    return join_hot(marked, materialise(named, "print-groups"), "fp", "n").select("id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
