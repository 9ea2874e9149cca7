"""Progressive JPEG: scans into coefficient arrays, numpy inverse transform, full-resolution RGB.

`decode` reads any three-component or grey progressive file without restart intervals: it accumulates DC and
AC scans (spectral selection, successive approximation) into coefficient arrays.  `pack_bytes` writes bytes as quantised
coefficients of such a file, losslessly: byte b becomes b - 128 moved away from zero by two, so
that no coefficient is zero after the point transform and the codes of a scan have one length; `unpack_bytes`
gets the bytes back from the decoded coefficients.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, whole_text

UNIT = 576
PAD = 255


@cache
def zigzag() -> np.ndarray:
    """Row-major place of each zigzag position."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[1] if (x[0] + x[1]) % 2 == 0 else x[0]))
    return np.array([8 * r + c for r, c in cells])


@cache
def transform() -> np.ndarray:
    """(64, 64): zigzag coefficients times this are the samples, row-major."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.where(k == 0, np.sqrt(1 / 8), np.sqrt(2 / 8)) * np.cos((2 * x + 1) * k * np.pi / 16)
    full = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return full[zigzag()].astype(np.float32)


@dataclass
class Component:
    h: int
    v: int
    quant: int
    rows: int = 0  # blocks, whole MCUs
    cols: int = 0
    own_rows: int = 0  # blocks of scans of this component alone
    own_cols: int = 0
    coefficients: np.ndarray | None = None  # (rows, cols, 64) in zigzag order


@dataclass
class Image:
    height: int = 0
    width: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    components: dict[int, Component] = field(default_factory=dict)
    comment: bytes = b""


class Huffman:
    """A decoding table over 16-bit windows."""

    def __init__(self, counts: np.ndarray, symbols: np.ndarray):
        lengths = np.repeat(np.arange(1, 17), counts)
        self.symbol = np.full(1 << 16, -1, np.int32)
        self.length = np.zeros(1 << 16, np.int32)
        fill = 1 << (16 - lengths)
        n = int(fill.sum())
        self.symbol[:n] = np.repeat(symbols, fill)
        self.length[:n] = np.repeat(lengths, fill)
        self.symbols, self.lengths = symbols, lengths
        self.known: dict[bool, tuple[int, np.ndarray] | None] = {}

    def uniform(self, ac: bool) -> tuple[int, np.ndarray] | None:
        """(bits, value by these bits) if each symbol stands for one value and all take as many bits with their extra ones."""
        if ac not in self.known:
            self.known[ac] = self._uniform(ac)
        return self.known[ac]

    def _uniform(self, ac: bool) -> tuple[int, np.ndarray] | None:
        total = set((self.lengths + (self.symbols & 15)).tolist())
        if len(total) != 1 or (bits := total.pop()) > 16 or (ac and not (np.all(self.symbols < 16) and np.all(self.symbols > 0))):
            return None
        window = np.arange(1 << bits) << (16 - bits)
        size, used = self.symbol[window] & 15, self.length[window]
        extra = (window << used & 0xFFFF) >> (16 - size)
        return bits, _extend(extra, size).astype(np.int16)


@lru_cache(maxsize=64)
def huffman_table(counts: bytes, symbols: bytes) -> Huffman:
    """The table of a DHT segment; files often share them."""
    return Huffman(np.frombuffer(counts, np.uint8).astype(int), np.frombuffer(symbols, np.uint8).astype(np.int32))


def _extend(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (extra < 1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra)


class Bits:
    """The bits of an entropy-coded segment without its stuffing."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.bytes = np.frombuffer(self.data + bytes(8), np.uint8)
        self.at = 0

    def groups(self, n: int, bits: int) -> np.ndarray:
        """The next n groups of so many bits (16 at most)."""
        if bits == 8 and self.at % 8 == 0:
            out = self.bytes[self.at // 8 : self.at // 8 + n]
        else:
            p = self.at + bits * np.arange(n)
            b = self.bytes
            at = p >> 3
            at = np.minimum(at, len(b) - 3)
            word = (b[at].astype(np.int32) << 16) | (b[at + 1].astype(np.int32) << 8) | b[at + 2]
            out = (word >> (24 - bits - (p & 7))) & ((1 << bits) - 1)
        self.at += n * bits
        return out

    def flags(self, n: int) -> np.ndarray:
        """The next n single bits."""
        a = self.at >> 3
        out = np.unpackbits(self.bytes[a : (self.at + n + 7) // 8])[self.at - 8 * a :][:n]
        self.at += n
        return out

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        a = self.at >> 3
        word = int.from_bytes(self.data[a : a + 4].ljust(4, b"\0"), "big")
        out = (word >> (32 - n - (self.at & 7))) & ((1 << n) - 1)
        self.at += n
        return out

    def next_symbol(self, table: Huffman) -> int:
        a = self.at >> 3
        word = int.from_bytes(self.data[a : a + 4].ljust(4, b"\0"), "big")
        window = (word >> (16 - (self.at & 7))) & 0xFFFF
        symbol = int(table.symbol[window])
        if symbol < 0:
            raise ValueError("a code is not in the table")
        self.at += int(table.length[window])
        return symbol


def _value(extra: int, size: int) -> int:
    return extra - (1 << size) + 1 if size and extra < 1 << (size - 1) else extra


def _dc_first(bits: Bits, tables: list[Huffman], owner: np.ndarray, low: int) -> np.ndarray:
    """DC values of blocks in scan order; owner is the place of each block's component."""
    one = tables[0].uniform(False) if all(t is tables[0] for t in tables) else None
    if one:
        diff = one[1][bits.groups(len(owner), one[0])].astype(np.int64)
    else:
        diff = np.zeros(len(owner), np.int64)
        for k, c in enumerate(owner.tolist()):
            size = bits.next_symbol(tables[c])
            diff[k] = _value(bits.take(size), size)
    out = np.zeros(len(owner), np.int64)
    for c in range(len(tables)):
        mine = owner == c
        out[mine] = np.cumsum(diff[mine])
    return out << low


def _ac_first(bits: Bits, table: Huffman, blocks: np.ndarray, first: int, last: int, low: int) -> None:
    """Fills coefficients first..last of blocks (n, 64)."""
    span = last - first + 1
    if one := table.uniform(True):
        values = one[1][bits.groups(len(blocks) * span, one[0])]
        blocks[:, first : last + 1] = (values << low).reshape(-1, span)
        return
    run = 0
    for block in blocks:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol = bits.next_symbol(table)
            r, size = symbol >> 4, symbol & 15
            if size == 0:
                if r < 15:
                    run = (1 << r) + bits.take(r) - 1
                    break
                k += 16
                continue
            k += r
            block[k] = _value(bits.take(size), size) << low
            k += 1


def _ac_refine(bits: Bits, table: Huffman, blocks: np.ndarray, first: int, last: int, low: int) -> None:
    """One more bit of the coefficients first..last, and those that become non-zero."""
    step = 1 << low
    at, n = 0, len(blocks)
    while at < n:
        block, k = blocks[at], first
        run = -1
        while k <= last:
            symbol = bits.next_symbol(table)
            r, size = symbol >> 4, symbol & 15
            fresh = 0
            if size == 0 and r < 15:
                run = (1 << r) + bits.take(r)
                break
            if size:
                fresh = step if bits.take(1) else -step
            while k <= last:
                if block[k]:
                    if bits.take(1) and not abs(int(block[k])) & step:
                        block[k] += step if block[k] > 0 else -step
                else:
                    if r == 0:
                        if fresh:
                            block[k] = fresh
                        k += 1
                        break
                    r -= 1
                k += 1
        if run < 0:
            at += 1
            continue
        # the rest of this block and the whole of the next ones have correction bits only
        part = blocks[at : at + run, first : last + 1]
        open_ = part != 0
        open_[0, : k - first] = False
        flat = part[open_]
        more = bits.flags(len(flat)).astype(bool) & ((np.abs(flat) & step) == 0)
        part[open_] = flat + np.where(more, np.where(flat > 0, step, -step), 0).astype(flat.dtype)
        at += run


def decode(data: bytes) -> Image:
    """The coefficients of a progressive JPEG file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, tables, at = Image(), {}, 2
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float32)
                image.quant[body[0] & 15] = values
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = huffman_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            for k in range(n):
                name, hv, q = body[6 + 3 * k : 9 + 3 * k]
                image.components[name] = Component(hv >> 4, hv & 15, q)
            hm, vm = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
            rows, cols = -(-image.height // (8 * vm)), -(-image.width // (8 * hm))
            for c in image.components.values():
                c.rows, c.cols = rows * c.v, cols * c.h
                c.own_rows = -(-(-(-image.height * c.v // vm)) // 8)
                c.own_cols = -(-(-(-image.width * c.h // hm)) // 8)
                c.coefficients = np.zeros((c.rows, c.cols, 64), np.int16)
        elif marker in (0xC0, 0xC1, 0xC3) or (marker == 0xDD and body != b"\0\0"):
            raise ValueError("only progressive files without restart intervals are read")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] != 0:
                    break
                end += 2
            _scan(image, tables, body, Bits(data[at:end]))
            at = end


def _scan(image: Image, tables: dict[int, Huffman], head: bytes, bits: Bits) -> None:
    n = head[0]
    parts = [(image.components[head[1 + 2 * k]], head[2 + 2 * k]) for k in range(n)]
    first, last, approx = head[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    if first == 0:
        if n == 1:
            c = parts[0][0]
            places = [np.arange(c.rows * c.cols).reshape(c.rows, c.cols)[: c.own_rows, : c.own_cols].ravel()]
            owner = np.zeros(len(places[0]), int)
            order = np.arange(len(owner))
        else:
            places, keys, owner = [], [], []
            for k, (c, _) in enumerate(parts):
                # MCU by MCU, a component's blocks row by row within each
                grid = np.arange(c.rows * c.cols).reshape(c.rows // c.v, c.v, c.cols // c.h, c.h).transpose(0, 2, 1, 3)
                places.append(grid.ravel())
                keys.append(np.repeat(np.arange(grid.shape[0] * grid.shape[1]), c.v * c.h))
                owner.append(np.full(grid.size, k))
            owner = np.concatenate(owner)
            order = np.lexsort((owner, np.concatenate(keys)))  # stable: blocks keep their order in an MCU
            owner = owner[order]
        flat = np.concatenate(places)[order]
        if high == 0:
            found = _dc_first(bits, [tables[t >> 4] for _, t in parts], owner, low)
        else:
            found = bits.flags(len(owner)).astype(np.int64) << low
        for k, (c, _) in enumerate(parts):
            mine = owner == k
            dc = c.coefficients.reshape(-1, 64)[:, 0]
            dc[flat[mine]] = found[mine] if high == 0 else dc[flat[mine]] | found[mine]
        return
    c, table = parts[0][0], tables[16 + (parts[0][1] & 15)]
    whole = c.own_rows == c.rows and c.own_cols == c.cols
    blocks = c.coefficients.reshape(-1, 64) if whole else c.coefficients[: c.own_rows, : c.own_cols].reshape(-1, 64).copy()
    (_ac_refine if high else _ac_first)(bits, table, blocks, first, last, low)
    if not whole:
        c.coefficients[: c.own_rows, : c.own_cols] = blocks.reshape(c.own_rows, c.own_cols, 64)


def to_rgb(image: Image) -> np.ndarray:
    """(height, width, 3) uint8; chroma is repeated up to full resolution."""
    planes = []
    hm, vm = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    for c in image.components.values():
        scaled = c.coefficients.reshape(-1, 64).astype(np.float32) * image.quant[c.quant]
        samples = np.clip(np.rint(scaled @ transform() + 128), 0, 255).astype(np.uint8)
        plane = samples.reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.cols)
        if c.v != vm or c.h != hm:
            plane = plane.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = (p.astype(np.float32) for p in planes)
    cb -= 128
    cr -= 128
    # fixed values: the JFIF conversion
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


# ---- bytes as coefficients


def _marker(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + struct.pack(">H", len(body) + 2) + body


@cache
def _tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    """The DHT segments, the 8 bits of each AC value v (at v + 64) and the 9 bits of each DC difference d (at d + 256)."""

    def segment(place: int, by_length: dict[int, list[int]]) -> bytes:
        return bytes([place, *(len(by_length.get(k, [])) for k in range(1, 17))]) + bytes(s for k in range(1, 17) for s in by_length.get(k, []))

    def codes(total: int, sizes: range, reach: int) -> np.ndarray:
        out = np.zeros(2 * reach + 1, np.int64)
        prefix = {s: (1 << (total - s)) - 2 for s in sizes}  # ones and a zero: the lengths are total - s
        for v in range(-reach, reach + 1):
            s = abs(v).bit_length()
            if s in prefix:
                out[v + reach] = (prefix[s] << s) | (v if v >= 0 else v + (1 << s) - 1)
        return out

    dc = segment(0x00, {9 - s: [s] for s in range(9)})
    ac = segment(0x10, {8 - s: [s] for s in range(1, 8)})
    ends = segment(0x11, {4: [r << 4 for r in range(15)]})
    return _marker(0xC4, dc) + _marker(0xC4, ac) + _marker(0xC4, ends), codes(8, range(1, 8), 64), codes(9, range(9), 256)


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _pack_bits(bits: np.ndarray) -> bytes:
    fill = -len(bits) % 8
    return _stuffed(np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)])).tobytes())


def _spread(values: np.ndarray, width: int) -> np.ndarray:
    return ((values[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).ravel()


#: (component, horizontal, vertical factors): two by two luma blocks to one of each chroma.
LAYOUT = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
BANDS = ((1, 5), (6, 63))


def pack_bytes(payload: bytes) -> bytes:
    """A progressive 4:2:0 file whose coefficients hold the payload, 64 bytes a block, in MCU order."""
    n = len(payload)
    mcus = -(-n // 384)
    across = -(-mcus // 4095)
    down = -(-mcus // across)
    raw = np.full(across * down * 384, PAD, np.uint8)
    raw[:n] = np.frombuffer(payload, np.uint8)
    moved = raw.astype(np.int16) - 128
    moved = np.where(moved >= 0, moved + 2, moved - 1).astype(np.int16).reshape(down, across, 6, 64)
    luma = moved[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    parts = {1: luma, 2: moved[:, :, 4].reshape(-1, 64), 3: moved[:, :, 5].reshape(-1, 64)}
    heads, ac_codes, dc_codes = _tables()
    out = [b"\xff\xd8", _marker(0xDB, b"\x00" + b"\x01" * 64), _marker(0xFE, struct.pack(">Q", n))]
    out.append(_marker(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in LAYOUT)))
    out.append(heads)
    every = b"".join(bytes([c, 0]) for c, _, _ in LAYOUT)
    # DC, all but the last bit
    dc = moved[:, :, :, 0].reshape(-1, 6).astype(np.int64)
    high = dc >> 1
    diff = np.concatenate([np.diff(high[:, :4].ravel(), prepend=0).reshape(-1, 4), np.diff(high[:, 4:], axis=0, prepend=0)], axis=1)
    out += [_marker(0xDA, b"\x03" + every + b"\x00\x00\x01"), _pack_bits(_spread(dc_codes[diff.ravel() + 256], 9))]
    # AC, all but the last bit
    for c, _, _ in LAYOUT:
        size = np.abs(parts[c]) >> 1
        value = np.where(parts[c] > 0, size, -size)
        for a, b in BANDS:
            codes = ac_codes[value[:, a : b + 1] + 64].astype(np.uint8)
            out += [_marker(0xDA, bytes([1, c, 0, a, b, 1])), _stuffed(codes.tobytes())]
    # AC, the last bit: runs of blocks without new values
    for c, _, _ in LAYOUT:
        low = (np.abs(parts[c][:, 1:]) & 1).astype(np.uint8)
        pieces = []
        for a in range(0, len(low), 16384):
            m = min(16384, len(low) - a)
            r = m.bit_length() - 1
            pieces += [_spread(np.array([r]), 4), _spread(np.array([m - (1 << r)]), r) if r else np.zeros(0, np.uint8), low[a : a + m].ravel()]
        out += [_marker(0xDA, bytes([1, c, 1, 1, 63, 0x10])), _pack_bits(np.concatenate(pieces))]
    out += [_marker(0xDA, b"\x03" + every + b"\x00\x00\x10"), _pack_bits((dc.ravel() & 1).astype(np.uint8)), b"\xff\xd9"]
    return b"".join(out)


def unpack_bytes(image: Image) -> bytes:
    """The payload of a file written by pack_bytes."""
    (n,) = struct.unpack(">Q", image.comment)
    y, cb, cr = (image.components[c].coefficients for c, _, _ in LAYOUT)
    down, across = cb.shape[:2]
    luma = y.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    moved = np.concatenate([luma, cb[:, :, None], cr[:, :, None]], axis=2).ravel()[:n]
    return np.where(moved > 0, moved - 2, moved + 1).astype(np.int16).__add__(128).astype(np.uint8).tobytes()


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % UNIT or (0 if text else UNIT))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each whole text as UTF-8 in a progressive JPEG file; null counts as empty.

    Repeated rows and null ids stay; other columns are left out; an empty table gives an empty one.  Few texts are held at a time, by number and
    by characters, one long text alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 256, 2_000_000):
                part = batch.slice(a, b - a)
                raw = [x.encode("utf-8", "surrogatepass") for x in texts[a:b]]
                media = [pack_bytes(padded(x)) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame, tensors: bool = False) -> DataFrame:
    """Decodes the media column: payload digests, media digests, a feature string and, if asked for, the RGB tensor.

    The feature is height x width and the mean of each colour to four places.  A null media value gives nulls.  Columns of those
    names are replaced, all others stay; repeated rows stay; an empty table gives an empty one.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + (["height", "width", "rgb"] if tensors else [])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + ([pa.int32(), pa.int32(), pa.binary()] if tensors else [])
    ddl = ["long", "string", "long", "long", "string", "string"] + (["int", "int", "binary"] if tensors else [])
    stored = stored.drop(*names)
    keep = [c for c in stored.columns if c != "media"]

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * len(names)
        image = decode(media)
        payload, rgb = unpack_bytes(image), to_rgb(image)
        means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (image.height * image.width)
        feature = f"{image.height}x{image.width}:" + ",".join(f"{m:.4f}" for m in means)
        row = (len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha256(media).hexdigest(), feature)
        return (*row, image.height, image.width, rgb.tobytes()) if tensors else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(len(keep)).to_pylist()
            for a, b in slices([x or b"" for x in media], 64, 4_000_000):
                part, rows = batch.slice(a, b - a), [one(x) for x in media[a:b]]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=[*keep, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name != "media"] + [f"{n} {t}" for n, t in zip(names, ddl)])
    return stored.select(*keep, "media").mapInArrow(run, schema)
