"""Best-fit packing of documents into fixed-length sequences, improved by swap-based local search.

Pieces of one length are interchangeable, so bins are packed by pattern: the input of the solver is the
count of each length (as many as the sequence length, whatever the corpus), its output a list
of patterns (multisets of lengths) with multiplicities.  Pieces then take their slots by their rank within
their length, which Spark computes over salted groups.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, tasks_for, whole_text
from .text_ids import worker_encoder

Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], size: int) -> Counter[Pattern]:
    """Bins by pattern: largest length first, then always the largest that still fits."""
    left = {k: n for k, n in counts.items() if n > 0}
    order = sorted(left)
    bins: Counter[Pattern] = Counter()
    while order:
        room, used = size, Counter()
        while room > 0:
            at = bisect_right(order, room) - 1
            while at >= 0 and left[order[at]] <= used[order[at]]:
                at -= 1
            if at < 0:
                break
            take = min(room // order[at], left[order[at]] - used[order[at]])
            used[order[at]] += take
            room -= take * order[at]
        times = min(left[k] // n for k, n in used.items())
        bins[tuple(sorted(used.elements(), reverse=True))] += times
        for k, n in used.items():
            left[k] -= n * times
        order = [k for k in order if left[k]]
    return bins


@lru_cache(maxsize=65536)
def _sums(pattern: Pattern) -> tuple[dict[int, Pattern], dict[int, Pattern], int, int]:
    """Sums of one length and of two lengths of a pattern, each with lengths that give it, and both as bits."""
    kinds = Counter(pattern)
    ones = {s: (s,) for s in kinds}
    twos = {a + b: (a, b) for a in kinds for b in kinds if a < b or (a == b and kinds[a] > 1)}
    return ones, twos, sum(1 << s for s in ones), sum(1 << s for s in twos)


def _exchange(target: Pattern, donor: Pattern, room: int) -> tuple[Pattern, Pattern] | None:
    """The move, one-for-one or two-for-one swap that adds most to the target within its room, or none."""
    give1, give2, bits1, bits2 = _sums(donor)
    take1, take2, _, _ = _sums(target)
    best, found, gains = 0, None, (2 << room) - 2
    for gives, bits, takes in ((give1, bits1, {0: ()}), (give1, bits1, take1), (give2, bits2, take1), (give1, bits1, take2)):
        for taken, parts in takes.items():
            # what can be given for it adds one of the gains whose bits are left
            most = (bits >> taken & gains).bit_length() - 1
            if most > best:
                best, found = most, (gives[taken + most], parts)
    if not found:
        return None
    give, take = map(Counter, found)
    new_target = Counter(target) - take + give
    new_donor = Counter(donor) - give + take
    return tuple(sorted(new_target.elements(), reverse=True)), tuple(sorted(new_donor.elements(), reverse=True))


#: Underfull bins from which on a search begins with the result for one half of them.
SEARCHED = 1000


def local_search(bins: Counter[Pattern], size: int) -> Counter[Pattern]:
    """Moves and swaps between underfull bins that raise the sum of squared fills, until none of them helps or the bound is met.

    The search of many bins begins with twice the result for one half of each pattern's bins and with the odd ones, and goes on over all of
    them, so that most steps are made for many bins at once.  Pairs of patterns that were found hopeless are so at any number.
    """
    return _levels(bins, size, set())


def _levels(bins: Counter[Pattern], size: int, hopeless: set) -> Counter[Pattern]:
    full = Counter({p: n for p, n in bins.items() if sum(p) == size and n})
    under = Counter({p: n for p, n in bins.items() if sum(p) < size and n})
    if sum(under.values()) > SEARCHED:
        half = _levels(Counter({p: n // 2 for p, n in under.items()}), size, hopeless)
        under = Counter({p: 2 * n for p, n in half.items()}) + Counter({p: n % 2 for p, n in under.items()})
        full += Counter({p: n for p, n in under.items() if sum(p) == size})
        under = Counter({p: n for p, n in under.items() if sum(p) < size and n})
    found = _searched(under, size, hopeless)
    hopeless.intersection_update([pair for pair in hopeless if pair[0] in found and pair[1] in found])
    return full + found


def _searched(bins: Counter[Pattern], size: int, hopeless: set | None = None) -> Counter[Pattern]:
    """All underfull patterns give and take: the emptiest with an untried partner gives next, to the fullest of those.

    Pairs found hopeless are not tried again; a new pattern is paired with all others.
    """
    bins = Counter({p: n for p, n in bins.items() if n})
    number, least = sum(bins.values()), -(-sum(sum(p) * n for p, n in bins.items()) // size)
    hopeless = set() if hopeless is None else hopeless
    untried: dict[Pattern, list] = {}
    donors: list[tuple[int, Pattern]] = []

    def pair(donor: Pattern, target: Pattern) -> None:
        if (target, donor) not in hopeless:
            if not untried.setdefault(donor, []):
                heappush(donors, (sum(donor), donor))
            heappush(untried[donor], (-sum(target), target))

    def enter(new: Pattern) -> None:
        for other in bins:
            if sum(other) < size and other != new:
                pair(*sorted((other, new), key=lambda p: (sum(p), p)))
        pair(new, new)

    for k, p in enumerate(order := sorted(bins, key=lambda p: (sum(p), p))):
        if sum(p) < size:
            for q in order[k:]:
                if sum(q) < size:
                    pair(p, q)
    while donors and number > least:
        _, donor = donors[0]
        if donor not in bins or not untried[donor]:
            heappop(donors)
            untried[donor] = []
            continue
        _, target = heappop(untried[donor])
        if target not in bins or (target, donor) in hopeless or (target == donor and bins[target] < 2):
            continue
        step = _exchange(target, donor, size - sum(target))
        if not step:
            hopeless.add((target, donor))
            continue
        times = bins[target] // 2 if target == donor else min(bins[target], bins[donor])
        for old in (target, donor):
            bins[old] -= times
            if not bins[old]:
                del bins[old]
        for new in step:
            if new:
                known = new in bins
                bins[new] += times
                if sum(new) < size:
                    pair(new, new) if known else enter(new)
        if target in bins and donor in bins:
            pair(donor, target)
        number -= times * (not all(step))
    return bins


def slots(bins: Counter[Pattern], first: int = 0) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, sequence, offset, per): ranks low <= r < high of a length go to sequence
    base + (r - low) div per, at offset + (r - low) mod per * length."""
    taken, out, base = Counter(), [], first
    for pattern, times in sorted(bins.items(), reverse=True):
        offset = 0
        for length, per in sorted(Counter(pattern).items(), reverse=True):
            low = taken[length]
            taken[length] += per * times
            out.append((length, low, taken[length], base, offset, per))
            offset += length * per
        base += times
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and the end id, cut into pieces.

    Documents over `size` are cut into full pieces after a first one that holds the rest.  Null text counts as empty, which is the end
    id alone; repeated rows and null ids stay; columns besides the id and the text are left out.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for batch in batches:
            rows = []
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode_rows(batch.column(1))):
                ids += end
                n = len(ids) // 4
                start, length = 0, n % size or size
                for k in range(-(-n // size)):
                    rows.append((name, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, length = start + length, size
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    return source.mapInArrow(run, schema)


def pack(items: DataFrame, size: int = 1024) -> DataFrame:
    """The rows of `items` (doc_id, piece, start, length up to `size`) with sequence_id and offset.

    Rows with equal length are interchangeable; repeated rows and null ids have places of their own.  Columns of those two names are replaced,
    all others stay, also those named as the work columns here.  An empty table gives an empty one.
    """
    items = items.drop("sequence_id", "offset")
    names = items.columns
    items = items.select("length", F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    spark = items.sparkSession
    salts = 2 * tasks_for(spark)
    salted = items.withColumn("_salt", F.floor(F.rand(7) * salts).cast("int"))  # fixed from here on, as the rows are written
    salted = materialise(salted, "pieces")
    groups = materialise(salted.groupBy("length", "_salt").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    placed = slots(local_search(best_fit(counts, size), size))
    table = spark.createDataFrame(placed or [(0, 0, 0, 0, 0, 0)], "length long, low long, high long, base long, at long, per long").coalesce(1)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = groups.select("length", "_salt", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("row.doc_id", "row.piece", "row.start")) - 1
    ranked = salted.withColumn("_own", own).join(starts.hint("merge"), ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    r, s = ranked.alias("r"), F.broadcast(table).alias("s")
    on = (F.col("r.length") == F.col("s.length")) & (F.col("r._rank") >= F.col("s.low")) & (F.col("r._rank") < F.col("s.high"))
    place = F.col("r._rank") - F.col("s.low")
    return r.join(s, on).select(
        *(F.col(f"r.row.`{c}`").alias(c) for c in names),
        (F.col("s.base") + F.floor(place / F.col("s.per"))).cast("long").alias("sequence_id"),
        (F.col("s.at") + place % F.col("s.per") * F.col("r.length")).cast("long").alias("offset"),
    )
