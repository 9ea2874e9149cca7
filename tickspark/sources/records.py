"""Binary files read in parallel byte ranges: fixed-size records and length-prefixed messages, and their writers.

Paths are those that pyarrow.fs opens on driver and executors alike (a shared folder, HDFS, S3, GCS).  No task holds a
whole file, and a file of any size is read by as many tasks as it has ranges.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

#: Fixed value: the 41-byte record, little-endian.
TICK = np.dtype([("ts_ns", "<u8"), ("price", "<f8"), ("bid", "<f8"), ("ask", "<f8"), ("volume", "<u8"), ("side", "S1")])
#: Bytes of message files that a task reads.
TASK_BYTES = 16 << 20
TICK_SCHEMA = "ts_ns long, price double, bid double, ask double, volume long, side string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def files_below(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files in a folder whose names do not begin with a dot or underscore, by name."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    inside = lambda x: not any(p[:1] in "._" for p in x.path[len(at) :].split("/") if p)
    return sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and inside(x))


def read_range(path: str, file: str, begin: int, size: int) -> bytes:
    fs, _ = opened(path)
    with fs.open_input_file(file) as f:
        return f.read_at(size, begin)


# ---- writing


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class BytesWriter(DataSourceArrowWriter):
    """One file for each task, moved to its place when all tasks have ended."""

    def __init__(self, path: str, encode, overwrite: bool):
        self.path, self.encode, self.overwrite, self.job = path, encode, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = opened(self.path)
        name = None
        out = None
        for batch in iterator:
            if out is None and batch.num_rows:
                name = f"{uuid.uuid4().hex}.bin"
                fs.create_dir(f"{at}/_{self.job}", recursive=True)
                out = fs.open_output_stream(f"{at}/_{self.job}/{name}")
            if batch.num_rows:
                out.write(self.encode(batch))
        if out is not None:
            out.close()
        return Written(name)

    def commit(self, messages) -> None:
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for file, _ in files_below(self.path):
                fs.delete_file(file)
        for k, m in enumerate(m for m in messages if m is not None and m.name):
            fs.move(f"{at}/_{self.job}/{m.name}", f"{at}/part-{k:05d}-{self.job}.bin")
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, at = opened(self.path)
        if fs.get_file_info(f"{at}/_{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/_{self.job}")


def encode_ticks(batch: pa.RecordBatch) -> bytes:
    out = np.zeros(batch.num_rows, TICK)
    for name in ("ts_ns", "price", "bid", "ask", "volume"):
        out[name] = batch.column(name).to_numpy(zero_copy_only=False)
    out["side"] = [(x or " ").encode()[:1] for x in batch.column("side").to_pylist()]
    return out.tobytes()


def encode_frames(batch: pa.RecordBatch) -> bytes:
    """Each message behind its length in two bytes, big-endian."""
    return b"".join(len(m).to_bytes(2, "big") + m for m in batch.column(0).to_pylist() if m)


# ---- fixed records


@dataclass
class Records(InputPartition):
    file: str
    first: int
    count: int

    def __init__(self, file: str, first: int, count: int):
        self.file, self.first, self.count = file, first, count


class TickReader(DataSourceReader):
    """Ranges of records; time bounds are applied to the records and, in sorted files, to the ranges that are read."""

    def __init__(self, options):
        self.path = options["path"]
        self.step = int(options.get("records", 1_000_000))
        self.sorted = str(options.get("sorted", "false")).lower() == "true"
        self.low, self.high = 0, (1 << 63) - 1

    def pushFilters(self, filters):
        for f in filters:
            on_time = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("ts_ns",)
            if not on_time or f.value is None:
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))

    def _bisect(self, f, count: int, bound: int) -> int:
        """The first record of a sorted file at or after a time."""
        low, high = 0, count
        while low < high:
            mid = (low + high) // 2
            if int.from_bytes(f.read_at(8, mid * TICK.itemsize), "little") < bound:
                low = mid + 1
            else:
                high = mid
        return low

    def partitions(self):
        out = []
        for file, size in files_below(self.path):
            first, last = 0, size // TICK.itemsize
            if self.sorted and last:
                fs, _ = opened(self.path)
                with fs.open_input_file(file) as f:
                    first, last = self._bisect(f, last, self.low), self._bisect(f, last, self.high + 1)
            out += [Records(file, k, min(self.step, last - k)) for k in range(first, last, self.step)]
        return out

    def read(self, partition):
        if partition is None:
            return
        for at in range(0, partition.count, 100_000):
            n = min(100_000, partition.count - at)
            rec = np.frombuffer(read_range(self.path, partition.file, (partition.first + at) * TICK.itemsize, n * TICK.itemsize), TICK)
            rec = rec[(rec["ts_ns"] >= self.low) & (rec["ts_ns"] <= self.high)]
            kinds = {"ts_ns": np.int64, "volume": np.int64}
            columns = [pa.array(np.ascontiguousarray(rec[c]).astype(kinds.get(c, np.float64))) for c in ("ts_ns", "price", "bid", "ask", "volume")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rec["side"].astype(str), pa.string())], names=["ts_ns", "price", "bid", "ask", "volume", "side"])


class FixedTicks(DataSource):
    """Files of 41-byte ticks; options path, records (a partition), sorted (files in time order), for reading and writing."""

    @classmethod
    def name(cls) -> str:
        return "fixed_ticks"

    def schema(self) -> str:
        return TICK_SCHEMA

    def reader(self, schema) -> TickReader:
        return TickReader(self.options)

    def writer(self, schema, overwrite: bool) -> BytesWriter:
        return BytesWriter(self.options["path"], encode_ticks, overwrite)


class Frames(DataSource):
    """A sink of length-prefixed messages (option path); read_frames reads them."""

    @classmethod
    def name(cls) -> str:
        return "message_frames"

    def schema(self) -> str:
        return "data binary"

    def writer(self, schema, overwrite: bool) -> BytesWriter:
        return BytesWriter(self.options["path"], encode_frames, overwrite)


def read_fixed_ticks(spark: SparkSession, path: str, start_ns: int | None = None, end_ns: int | None = None, records: int = 1_000_000, in_order: bool = False) -> DataFrame:
    """Ticks of 41-byte record files, cut to a closed time range while they are read; a broken last record is left out.

    Ranges of `records` records are read by a task each.  in_order says that each file is in time order: then the range's
    ends are found by bisection and nothing outside is read.
    """
    spark.dataSource.register(FixedTicks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("fixed_ticks").options(path=path, records=records, sorted=in_order).load()
    if start_ns is not None:
        df = df.filter(df["ts_ns"] >= start_ns)
    return df if end_ns is None else df.filter(df["ts_ns"] <= end_ns)


def write_fixed_ticks(df: DataFrame, path: str, mode: str = "append") -> None:
    """(ts_ns, price, bid, ask, volume, side) rows as record files, one for each task, in the tasks' order; nulls are zero or a blank."""
    df.sparkSession.dataSource.register(FixedTicks)
    columns = [c.split()[0] for c in TICK_SCHEMA.split(", ")]
    df.select(*columns).na.fill(0, columns[:-1]).write.format("fixed_ticks").mode(mode).option("path", path).save()


# ---- length-prefixed messages


def exits(raw: np.ndarray, size: int, most: int, left: int) -> np.ndarray:
    """For each entry (a message begins so many bytes into the range): how far beyond the range the first message after it begins, -1 if none can.

    The ways from all entries are followed until they leave the range, break off or meet a place that was passed before: most
    entries end or meet soon, and no place is passed twice.
    """
    data, ends = raw.tobytes(), {}
    for entry in range(min(most + 2, size)):
        at, way = entry, []
        while 0 <= at < size and at not in ends:
            way.append(at)
            length = (data[at] << 8) | data[at + 1]
            to = at + 2 + length
            at = left if to > left else to if length <= most else -1
        end = ends[at] if at in ends else at - size if at >= 0 else -1
        ends.update(dict.fromkeys(way, end))
    # an entry may lie beyond a short last range
    return np.array([ends[e] if e < size else e - size for e in range(most + 2)])


def starts_from(raw: np.ndarray, size: int, most: int, left: int, entry: int) -> np.ndarray:
    """The places of all messages that begin in the range, from the one at `entry` on."""
    data, found, at = raw.tobytes(), [], entry
    while at < size:
        found.append(at)
        length = (data[at] << 8) | data[at + 1]
        to = at + 2 + length
        if to <= left and length > most:
            raise ValueError(f"a message is longer than {most} bytes")
        at = min(to, left)
    return np.array(found, np.int64)


def read_frames(spark: SparkSession, path: str, max_length: int = 1024, range_bytes: int = 4_000_000) -> DataFrame:
    """(file, place, data): the messages of length-prefixed files, each read in parallel ranges; a broken last message is left out.

    Where messages begin in a range depends on all before it.  Each range first finds, for every entry a message of at most
    `max_length` bytes allows, the entry into the next range; composing these maps, one small row a range, gives
    every range its own entry, and the ranges are then cut into messages.  Messages of no bytes are skipped, longer ones raise.
    """
    if range_bytes < max_length + 2:
        raise ValueError("a range must have room for a message")
    ranges = [(file, k, at, size) for file, size in files_below(path) for k, at in enumerate(range(0, size, range_bytes))]
    # the number of tasks is set, as rows so small would all be put into a few; a task has many ranges of a large input
    least, total = 2 * spark.sparkContext.defaultParallelism, sum(min(range_bytes, size - at) for _, _, at, size in ranges)
    parts = max(1, min(len(ranges), max(least, total // TASK_BYTES)))
    table = spark.createDataFrame(ranges or [("", 0, 0, 0)], "file string, number int, begin long, size long").filter("size > 0")
    table = table.repartition(parts, "file", "number")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = min(range_bytes, row["size"] - row["begin"])
                raw = np.frombuffer(read_range(path, row["file"], row["begin"], n + 1).ljust(n + 1, b"\0"), np.uint8)
                yield pa.RecordBatch.from_pydict({"file": [row["file"]], "number": pa.array([row["number"]], pa.int32()), "map": pa.array([exits(raw, n, max_length, row["size"] - row["begin"]).tolist()], pa.list_(pa.int32()))})

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        entry, out = 0, []
        group = group.sort_values("number")
        for step in group["map"]:
            out.append(entry)
            # beyond a map is the end of the file
            entry = int(step[entry]) if 0 <= entry < len(step) else entry
        return pd.DataFrame({"file": group["file"], "number": group["number"], "entry": out})

    entries = table.mapInArrow(maps, "file string, number int, map array<int>").groupBy("file").applyInPandas(scan, "file string, number int, entry int")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["entry"] < 0:
                    raise ValueError(f"a message before byte {row['begin']} of {row['file']} is longer than {max_length} bytes")
                n = min(range_bytes, row["size"] - row["begin"])
                data = read_range(path, row["file"], row["begin"], n + max_length + 2)
                raw = np.frombuffer(data.ljust(n + 1, b"\0"), np.uint8)
                begin = starts_from(raw, n, max_length, row["size"] - row["begin"], row["entry"])
                length = (raw[begin].astype(np.int64) << 8) | raw[begin + 1]
                whole = (length > 0) & (begin + 2 + length <= row["size"] - row["begin"])
                begin, length = begin[whole], length[whole]
                messages = pa.array([data[a : a + k] for a, k in zip((begin + 2).tolist(), length.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(begin), pa.string()), pa.array(row["begin"] + begin), messages], names=["file", "place", "data"])

    return table.join(entries, ["file", "number"]).repartition(parts, "file", "number").mapInArrow(cut, "file string, place long, data binary")


def write_frames(df: DataFrame, path: str, col: str = "data", mode: str = "append") -> None:
    """The messages of a binary column (65,535 bytes at most, null and empty ones left out) as length-prefixed files, one for each task."""
    df.sparkSession.dataSource.register(Frames)
    df.select(df[col].alias("data")).write.format("message_frames").mode(mode).option("path", path).save()
