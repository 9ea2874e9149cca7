"""Record and message files in parallel byte ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.sources import records as R


def stream(rng, n, most):
    messages = [rng.randbytes(rng.choice([0, 1, 2, rng.randrange(most + 1), most])) for _ in range(n)]
    return messages, b"".join(len(m).to_bytes(2, "big") + m for m in messages)


def expected(files):
    """(file, place, message) of a plain loop over each file."""
    out = []
    for file, data in files.items():
        at = 0
        while at + 2 <= len(data):
            n = int.from_bytes(data[at : at + 2], "big")
            if at + 2 + n > len(data):
                break
            if n:
                out.append((file, at, data[at + 2 : at + 2 + n]))
            at += 2 + n
    return sorted(out)


@pytest.mark.parametrize("range_bytes", [42, 97, 1000])
def test_messages_of_any_ranges(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    whole = [stream(rng, n, 40)[1] for n in (0, 1, 60, 300)]
    contents = [*whole, whole[2][:-1], whole[3] + b"\x00", whole[3] + b"\x7f", whole[2] + b"\xff\xffbroken", b"\x00"]
    files = {}
    for k, data in enumerate(contents):
        path = tmp_path / f"f{k}.bin"
        path.write_bytes(data)
        files[str(path)] = data
    (tmp_path / "_hidden").write_bytes(b"\0\1x")
    got = R.read_frames(spark, str(tmp_path), max_length=40, range_bytes=range_bytes)
    assert sorted((r.file, r.place, bytes(r.data)) for r in got.collect()) == expected(files)


def test_maps_compose_to_the_starts():
    rng = random.Random(1)
    _, data = stream(rng, 400, 30)
    raw, step, entry, found = np.frombuffer(data + b"\0", np.uint8), 64, 0, []
    for at in range(0, len(data), step):
        n = min(step, len(data) - at)
        own, left = raw[at : at + n + 1], len(data) - at
        found += list(at + R.starts_from(own, n, 30, left, entry))
        exits = R.exits(own, n, 30, left)
        assert len(exits) == 32
        entry = int(exits[entry])
    want, at = [], 0
    while at < len(data):
        want.append(at)
        at += 2 + int.from_bytes(data[at : at + 2], "big")
    assert found == want


def test_messages_are_cut_in_as_many_tasks_as_asked_for(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(b"\0\2xy" * 5000)
    got = R.read_frames(spark, str(tmp_path), max_length=40, range_bytes=100)
    most = 2 * spark.sparkContext.defaultParallelism
    # few bytes a range, whose rows Spark would put into one task; 200 ranges are not as many tasks
    assert got.rdd.getNumPartitions() == most and got.count() == 5000
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > most // 2
    monkeypatch.setattr(R, "TASK_BYTES", 500)
    assert R.read_frames(spark, str(tmp_path), max_length=40, range_bytes=100).rdd.getNumPartitions() == 40


def test_too_long_messages_raise(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes((50).to_bytes(2, "big") + b"x" * 50 + b"\0\1y" * 100)
    with pytest.raises(Exception, match="longer than 40"):
        R.read_frames(spark, str(tmp_path), max_length=40, range_bytes=60).collect()
    with pytest.raises(ValueError):
        R.read_frames(spark, str(tmp_path), max_length=40, range_bytes=10)


def test_written_messages_come_back(spark, tmp_path):
    rows = [(bytes([k % 256]) * (k % 50),) for k in range(500)] + [(None,)]
    R.write_frames(spark.createDataFrame(rows, "data binary").repartition(3), str(tmp_path / "m"))
    got = R.read_frames(spark, str(tmp_path / "m"), max_length=50, range_bytes=200)
    assert sorted(bytes(r.data) for r in got.collect()) == sorted(m for (m,) in rows if m)
    assert got.select("file").distinct().count() == 3


def ticks(n):
    return [(1000 + 10 * k, k * 0.5, k - 0.5, k + 0.5, k, "AB"[k % 2]) for k in range(n)]


def test_one_file_of_records_is_read_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    R.write_fixed_ticks(spark.createDataFrame(ticks(1000), R.TICK_SCHEMA).coalesce(1), path)
    [(file, size)] = R.files_below(path)
    assert size == 41_000
    with open(file, "ab") as f:
        f.write(b"broken")
    df = R.read_fixed_ticks(spark, path, records=64)
    assert df.rdd.getNumPartitions() == 16
    assert [tuple(r) for r in df.collect()] == ticks(1000)
    # a time range is cut while reading; in files in time order only its records are read
    for in_order, parts in ((False, 16), (True, 4)):
        cut = R.read_fixed_ticks(spark, path, 3000, 5005, records=64, in_order=in_order)
        assert [tuple(r) for r in cut.collect()] == [t for t in ticks(1000) if 3000 <= t[0] <= 5005]
        assert cut.rdd.getNumPartitions() == parts
    assert R.read_fixed_ticks(spark, path, 10**9, in_order=True).count() == 0


def test_append_overwrite_and_nulls(spark, tmp_path):
    path = str(tmp_path / "t")
    R.write_fixed_ticks(spark.createDataFrame(ticks(5), R.TICK_SCHEMA), path)
    R.write_fixed_ticks(spark.createDataFrame([(1, None, 2.0, 3.0, None, None)], R.TICK_SCHEMA), path)
    got = [tuple(r) for r in R.read_fixed_ticks(spark, path).collect()]
    assert sorted(got) == sorted([*ticks(5), (1, 0.0, 2.0, 3.0, 0, " ")])
    R.write_fixed_ticks(spark.createDataFrame(ticks(2), R.TICK_SCHEMA), path, "overwrite")
    assert sorted(tuple(r) for r in R.read_fixed_ticks(spark, path).collect()) == ticks(2)
    R.write_fixed_ticks(spark.createDataFrame([], R.TICK_SCHEMA), str(tmp_path / "none"))
    assert R.read_fixed_ticks(spark, str(tmp_path / "none")).count() == 0
