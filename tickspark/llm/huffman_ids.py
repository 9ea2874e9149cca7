"""Token ids in a binary file format: canonical length-limited Huffman codes from global counts.

A file is a table of segments in ascending id order; a segment holds whole documents and knows the number of ids
before it.  Its payload is a header, the documents' lengths, bit offsets of the blocks (checkpoints), and the code bits of blocks of
a fixed number of ids, each of which can be decoded on its own.  The code lengths of all
ids (one byte each) stand in the code table that is written beside the segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, tasks_for, whole_text
from .text_ids import worker_encoder

MAGIC = b"TSH1"
BLOCK = 1024
MAX_BITS = 20


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits for the ids with a count (package-merge); 0 for the others."""
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    if n > 1 << max_bits:
        raise ValueError("max_bits is too small for so many ids")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels = []  # for each level: which of the merged items are leaves
    items = weight
    for _ in range(max_bits - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weight, pairs])
        place = np.argsort(merged, kind="stable")
        levels.append(place < n)
        items = merged[place]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    per = np.bincount(lengths[order], minlength=256)
    at = 0
    for bits in range(1, 256):
        code <<= bits - last
        last = bits
        m = int(per[bits])
        codes[order[at : at + m]] = np.arange(code, code + m)
        code += m
        at += m
        if at == len(order):
            break
    return codes


class Coder:
    """Encodes and decodes segments with one code; the decoder is a table over all windows of the longest code."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(lengths).astype(np.uint64)
        self.width = int(self.lengths.max(initial=1))
        self.symbols = self.steps = None

    def _table(self) -> None:
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        fill = 1 << (self.width - self.lengths[order])
        self.symbols = np.zeros(1 << self.width, np.int32)
        self.steps = np.ones(1 << self.width, np.uint8)
        n = int(fill.sum())
        self.symbols[:n] = np.repeat(order, fill)
        self.steps[:n] = np.repeat(self.lengths[order], fill)

    def encode(self, ids: np.ndarray, doc_lengths: np.ndarray) -> bytes:
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        total = int(ends[-1]) if len(ids) else 0
        starts = ends - bits
        words = np.zeros(total // 64 + 2, np.uint64)
        at, shift = starts >> 6, (starts & 63).astype(np.uint64)
        value = self.codes[ids] << (np.uint64(64) - bits.astype(np.uint64))  # left-aligned
        if len(ids):
            first = np.flatnonzero(np.diff(at, prepend=-1))
            words[at[first]] = np.bitwise_or.reduceat(value >> shift, first)
            cross = np.flatnonzero((starts & 63) + bits > 64)
            words[at[cross] + 1] |= value[cross] << (np.uint64(64) - shift[cross])
        body = words.astype(">u8").tobytes()[: (total + 7) // 8]
        marks = starts[::BLOCK].astype("<u8").tobytes()
        return MAGIC + struct.pack("<QQQ", len(doc_lengths), len(ids), len(body)) + doc_lengths.astype("<u4").tobytes() + marks + body

    def decode(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths of the documents)."""
        if self.symbols is None:
            self._table()
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        n_docs, n_ids, n_body = struct.unpack_from("<QQQ", data, 4)
        docs = np.frombuffer(data, "<u4", n_docs, 28).astype(np.int64)
        n_blocks = -(-n_ids // BLOCK)
        at = 28 + 4 * n_docs
        bit = np.frombuffer(data, "<u8", n_blocks, at).astype(np.int64)
        body = np.frombuffer(data + bytes(8), np.uint8, n_body + 8, at + 8 * n_blocks)
        # 32 bits from every byte on: a window of up to 24 bits at any bit offset
        spread = np.ndarray((len(body) - 3,), ">u4", body.data, strides=(1,)).astype(np.uint32)
        out = np.zeros((n_blocks, BLOCK), np.int32)
        down, mask = np.int64(32 - self.width), np.int64((1 << self.width) - 1)
        symbols, steps = self.symbols, self.steps
        last = n_ids - (n_blocks - 1) * BLOCK if n_blocks else 0
        for k in range(BLOCK if n_blocks > 1 else last):
            if k == last:
                bit = bit[:-1]
            window = (spread[bit >> 3].astype(np.int64) >> (down - (bit & 7))) & mask
            out[: len(bit), k] = symbols[window]
            bit = bit + steps[window]
        return out.ravel()[:n_ids], docs


def id_segments(docs: DataFrame, tokenizer: str, end_id: int = 0, per_segment: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, seg, first, n_ids, doc_ids, lengths, wide, ids): ids of whole documents as uint16 or uint32, in ascending id order over (part, seg).

    first is the number of ids before the segment in its part.  Null text counts as empty; rows with a null id come first;
    repeated ids keep their rows, in any order.  An id that many rows share is dealt over several parts.  A text longer than a segment is a
    segment of its own.  Other columns are left out; an empty table gives no segment.
    """
    schema = "part int, seg int, first long, n_ids long, doc_ids array<long>, lengths array<long>, wide boolean, ids binary"
    types = {"part": pa.int32(), "seg": pa.int32(), "first": pa.int64(), "n_ids": pa.int64(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "wide": pa.bool_(), "ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = worker_encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        names, data, held, seg, first = [], [], 0, 0, 0

        def flush():
            ids = np.frombuffer(b"".join(data), "<u4")
            wide = bool(len(ids) and ids.max() > 65535)
            row = {"part": part, "seg": seg, "first": first, "n_ids": len(ids), "doc_ids": names, "lengths": [len(x) // 4 for x in data], "wide": wide, "ids": (ids if wide else ids.astype("<u2")).tobytes()}
            return pa.RecordBatch.from_arrays([pa.array([v], types[k]) for k, v in row.items()], names=list(row))

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode_rows(batch.column(1))):
                names.append(key)
                data.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= per_segment:
                    yield flush()
                    names, data, first, held, seg = [], [], first + held, 0, seg + 1
        if names:
            yield flush()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text"), F.monotonically_increasing_id().alias("turn"))
    parts = tasks_for(docs.sparkSession)
    return source.repartitionByRange(parts, "doc_id", "turn").sortWithinPartitions("doc_id").select("doc_id", "text").mapInArrow(run, schema)


def _ids(data: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(data, "<u4" if wide else "<u2")


def count_ids(segments: DataFrame) -> DataFrame:
    """(id, n) over all segments; each task sums its own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for data, wide in zip(batch["ids"], batch["wide"]):
                found = np.bincount(_ids(data, wide), minlength=len(total))
                found[: len(total)] += total
                total = found
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids, "n": total[ids]})

    return segments.select("ids", "wide").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, vocabulary: int = 1 << 17) -> None:
    """Writes `path`/codes (id, bits) and `path`/segments (start, n_ids, doc_ids, payload); start is the number of ids of all segments before.

    The code table is made on the driver and sent to every task, so ids have a bound: one of `vocabulary` or more raises.
    """
    segments = materialise(id_segments(docs, tokenizer, end_id), "id-segments")
    counts = count_ids(segments).collect()  # as many as the vocabulary has at most
    table = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    if len(table) > vocabulary:
        raise ValueError("an id is beyond the vocabulary")
    for r in counts:
        table[r["id"]] = r["n"]
    lengths = code_lengths(table)
    spark = docs.sparkSession
    rows = pd.DataFrame({"id": np.arange(len(lengths)), "bits": lengths.astype(int)})
    spark.createDataFrame(rows, "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(lengths)
        for batch in batches:
            payload = [coder.encode(_ids(d, w), np.array(n, np.int64)) for d, w, n in zip(batch["ids"], batch["wide"], batch["lengths"])]
            yield pd.DataFrame({"start": batch["start"], "n_ids": batch["n_ids"], "doc_ids": batch["doc_ids"], "payload": payload})

    # one row for each range partition, whose number is set before the ids are made
    by_part = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = by_part.select("part", before.alias("base"))
    placed = segments.join(F.broadcast(bases), "part").select((F.col("base") + F.col("first")).alias("start"), "n_ids", "doc_ids", "lengths", "wide", "ids")
    coded = placed.mapInPandas(run, "start long, n_ids long, doc_ids array<long>, payload binary")
    coded.write.option("compression", "none").parquet(f"{path}/segments")


def read_ids(spark, path: str, texts: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<int>]) of every document, decoded from the files in one pass.

    start is the number of ids of all documents before it in the files' order.
    """
    codes = spark.read.parquet(f"{path}/codes").orderBy("id").toPandas()  # as many as the vocabulary has at most
    lengths = codes["bits"].to_numpy(np.uint8)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if texts else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(lengths)
        for batch in batches:
            for start, names, payload in zip(batch["start"], batch["doc_ids"], batch["payload"]):
                ids, n = coder.decode(payload)
                ends = np.cumsum(n)
                data = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                out = pd.DataFrame({"doc_id": pd.array(names, dtype="Int64"), "start": start + ends - n, "n_tokens": n, "ids_crc32": crc})
                if texts:
                    out["ids"] = [ids[e - k : e].tolist() for e, k in zip(ends.tolist(), n.tolist())]
                yield out

    return spark.read.parquet(f"{path}/segments").select("start", "doc_ids", "payload").mapInPandas(run, schema)
