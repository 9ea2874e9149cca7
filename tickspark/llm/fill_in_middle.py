"""Fill-in-the-middle rows: a text is cut into prefix, middle and suffix, which are put together in another order.

Where to cut and in which form is decided by the row's id, in SQL functions.  The pieces are made by a pipeline of
pyarrow.compute calls on whole batches: units (code points) as list arrays, flattened beside the indices of their rows, numbered
within their row, filtered by the part they belong to, rebuilt as lists and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slices, whole_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that go through the pipeline at once; a longer text goes in several runs.
AT_ONCE = 1_000_000
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


def split_units(texts: pa.StringArray) -> pa.ListArray:
    """The code points of each text as a list of strings; the bytes are shared, not copied."""
    lengths = np.asarray(pc.binary_length(texts), np.int64)
    ends = np.cumsum(lengths)
    data = texts.buffers()[2]
    begin = int(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]) if len(texts) else 0
    size = int(ends[-1]) if len(texts) else 0
    raw = np.frombuffer(data, np.uint8, size, begin) if size else np.zeros(0, np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, size).astype(np.int32)), pa.py_buffer(raw))
    offsets = np.searchsorted(starts, np.concatenate([[0], ends])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), units)


def cut(texts: pa.StringArray, base: pa.Array, first: pa.Array, second: pa.Array) -> list[pa.StringArray]:
    """Prefix, middle and suffix of each text: its units before number `first`, before `second`, and the rest; its first unit has number `base`."""
    units = split_units(texts)
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    ordinal = pc.subtract(pa.array(np.arange(len(flat), dtype=np.int64)), pc.take(pc.subtract(units.offsets[:-1].cast(pa.int64()), base), parent))
    before = pc.less(ordinal, pc.take(first, parent))
    inside = pc.and_not(pc.less(ordinal, pc.take(second, parent)), before)
    after = pc.invert(pc.or_(before, inside))
    return [_joined(pc.filter(flat, role), pc.filter(parent, role), len(texts)) for role in (before, inside, after)]


def _joined(pieces: pa.Array, parent: pa.Array, rows: int) -> pa.StringArray:
    """The pieces of each row, which stand together, as one string."""
    counts = np.bincount(np.asarray(parent), minlength=rows)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pieces), "")


def arranged(form: pa.Array, prefix: pa.Array, middle: pa.Array, suffix: pa.Array) -> pa.Array:
    """The output rows: plain, prefix-suffix-middle or suffix-prefix-middle."""
    join = pc.binary_join_element_wise
    psm = join(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = join(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    plain = join(prefix, middle, suffix, "")
    return pc.if_else(pc.equal(form, "plain"), plain, pc.if_else(pc.equal(form, "psm"), psm, spm))


def _outputs(texts: list[str], form: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Texts longer than AT_ONCE are taken in chunks, whose pieces are joined by row again."""
    owner = [k for k, x in enumerate(texts) for _ in range(0, max(len(x), 1), AT_ONCE)]
    chunks = [x[at : at + AT_ONCE] for x in texts for at in range(0, max(len(x), 1), AT_ONCE)]
    base = [at for x in texts for at in range(0, max(len(x), 1), AT_ONCE)]
    found: list[list[pa.Array]] = [[], [], []]
    for a, b in slices(chunks, len(chunks), AT_ONCE):
        rows = pa.array(owner[a:b], pa.int64())
        for whole, part in zip(found, cut(pa.array(chunks[a:b], pa.string()), pa.array(base[a:b], pa.int64()), pc.take(first, rows), pc.take(second, rows))):
            whole.append(part)
    parts = [_joined(pa.concat_arrays(x), pa.array(owner, pa.int64()), len(texts)) for x in found]
    return arranged(form, *parts)


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, apply_pct: int = 90, spm_pct: int = 20) -> DataFrame:
    """The rows with n, form, prefix_chars and middle_chars, from the SHA-256 of `seed:id`.

    A text that is empty or holds one of the three marks stays plain, as do 100 - apply_pct of a hundred; of the others
    spm_pct of a hundred are suffix-prefix-middle.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    text, n = whole_text(F.col(text_col)), F.col("n")
    out = docs.drop(*NEW).withColumns({"n": F.char_length(text).cast("long"), "_digest": digest})
    draws = [_draw(F.col("_digest"), k) for k in range(4)]
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((n == 0) | marked | (draws[2] % 100 >= apply_pct), "plain").when(draws[3] % 100 < spm_pct, "spm").otherwise("psm")
    ends = draws[0] % (n + 1), draws[1] % (n + 1)
    out = out.withColumns({"form": form, "_first": F.least(*ends), "_second": F.greatest(*ends)})
    used = F.col("form") != "plain"
    return out.withColumns({"prefix_chars": F.when(used, F.col("_first")), "middle_chars": F.when(used, F.col("_second") - F.col("_first"))}).drop("_digest", "_first", "_second")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, apply_pct: int = 90, spm_pct: int = 20) -> DataFrame:
    """The rows of `docs` with n (code points), form, prefix_chars, middle_chars (null if plain) and output.

    Null text counts as empty and gives an empty plain output; a null id counts as an empty string; repeated rows get
    equal outputs; columns named as the new ones are replaced; texts of any length are taken whole; no rows give none.
    """
    planned = plan(docs, id_col, text_col, seed, apply_pct, spm_pct)
    names = planned.columns
    at = {c: names.index(c) for c in (text_col, "form", "prefix_chars", "middle_chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(at[text_col]).to_pylist()]
            first = pc.fill_null(batch.column(at["prefix_chars"]), 0)
            second = pc.add(first, pc.fill_null(batch.column(at["middle_chars"]), 0))
            for a, b in slices(texts, 4096, AT_ONCE):
                own = batch.slice(a, b - a)
                output = _outputs(texts[a:b], own.column(at["form"]), first.slice(a, b - a), second.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*own.columns, output], names=[*names, "output"])

    schema = type(planned.schema)(planned.schema.fields[:]).add("output", "string")
    return planned.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of; each mark stands in it once, as texts that hold one stay plain."""
    x = F.col(output)

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(x, a, -1), b, 1)

    middle = F.substring_index(x, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "plain", x).when(F.col(form) == "psm", psm).otherwise(spm)
