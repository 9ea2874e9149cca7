"""User-defined checks, features and aggregates called from SQL; payloads without a schema; retention of a store."""

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tickspark.functions import sql as Q
from tickspark.operators import altdata as A
from tickspark.sources import io as IO


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "3")
    yield
    spark.conf.unset(name)


def test_a_feature_carries_state_over_batches(spark, small_batches):
    def running(rows, state):
        total, out = state["total"], []
        for x in rows.column("x").to_pylist():
            total += x or 0
            out.append(total)
        state["total"] = total
        return pa.table({"k": rows.column("k"), "t": rows.column("t"), "total": pa.array(out, pa.int64())})

    Q.register_feature(spark, "running_total", running, "k long, t long, total long", lambda: {"total": 0})
    rows = [(k, t, None if t == 4 else t) for k in (1, 2, None) for t in range(10)]
    spark.createDataFrame(rows, "k long, t long, x long").repartition(4).createOrReplaceTempView("numbers")
    got = {tuple(r) for r in spark.sql("select * from running_total(table(numbers) partition by k order by t)").collect()}
    assert got == {(k, t, sum(x for x in range(t + 1) if x != 4)) for k, t, _ in rows}


def test_a_check_reports_each_partition(spark, small_batches):
    def count(rows, state):
        state["n"] += rows.num_rows
        state["k"] = str(rows.column("k")[0].as_py())

    Q.register_check(spark, "many_rows", count, lambda s: [("rows", s["k"], "FAIL" if s["n"] > 8 else "PASS")], lambda: {"n": 0, "k": None})
    spark.range(25).selectExpr("id % 3 k", "id").createOrReplaceTempView("some")
    assert {tuple(r) for r in spark.sql("select * from many_rows(table(some) partition by k)").collect()} == {("rows", "0", "FAIL"), ("rows", "1", "PASS"), ("rows", "2", "PASS")}
    spark.range(0).selectExpr("id k").createOrReplaceTempView("nothing")
    assert spark.sql("select * from many_rows(table(nothing) partition by k)").collect() == []


def test_an_aggregate_in_sql(spark):
    def spread(x: pa.Array) -> float:
        found = pc.min_max(x).as_py()
        return None if found["min"] is None else float(found["max"] - found["min"])

    Q.register_aggregate(spark, "spread_of", spread)
    spark.createDataFrame([(1, 2.0), (1, 5.5), (2, None)], "k int, x double").createOrReplaceTempView("xs")
    assert {r.k: r.s for r in spark.sql("select k, spread_of(x) s from xs group by k").collect()} == {1: 3.5, 2: None}


def test_payloads_of_any_shape(spark):
    rows = [(1, '{"a": 1, "b": {"c": [10, 20]}}'), (2, '{"a": "x"}'), (3, "{broken"), (4, None), (5, "[1, 2]"), (6, "{}"), (7, '{"a": null}')]
    df = A.payload_variant(spark.createDataFrame(rows, "id int, payload string"))
    got = {r.id: (r.a, r.c) for r in df.select("id", A.payload_value("$.a", "int").alias("a"), A.payload_value("$.b.c[1]", "int").alias("c")).collect()}
    assert got == {1: (1, 20), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None)}
    entries = {(r.id, r.key, r.value) for r in A.payload_entries(df, ["id"]).filter("pos is not null").collect()}
    assert entries == {(1, "a", "1"), (1, "b", '{"c":[10,20]}'), (2, "a", '"x"'), (5, None, "1"), (5, None, "2"), (7, "a", "null")}
    # the schema found is one that from_json takes
    schema = A.payload_schema(df.filter("id = 1"))
    read = A.decode_payload(spark.createDataFrame(rows[:1], "id int, payload string"), schema)
    assert read.select("a", "b.c").first() == (1, [10, 20])
    assert A.payload_schema(df.filter("id = 4")) == "VOID"


def store(spark, path):
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=k), float(k)) for s in (1, 2) for k in range(120)]
    IO.write_market_store(spark.createDataFrame(rows, "symbol int, ts timestamp_ntz, close double"), path)
    return rows


def files(path, month):
    return sorted((f.name, f.stat().st_mtime_ns) for f in (path / f"year_month={month}").iterdir())


def kept(spark, path):
    return sorted((r.symbol, r.ts, r.close) for r in spark.read.parquet(str(path)).collect())


def test_retention_touches_the_boundary_month_only(spark, tmp_path):
    path = tmp_path / "store"
    rows = store(spark, str(path))
    before = {m: files(path, m) for m in ("2024-03", "2024-04")}
    IO.retain(spark, str(path), 10, "2024-02-25 12:00:00")
    assert IO.store_months(spark, str(path)) == ["2024-02", "2024-03", "2024-04"]
    assert kept(spark, path) == sorted(r for r in rows if r[1] >= datetime(2024, 2, 15, 12))
    assert {m: files(path, m) for m in before} == before
    IO.retain(spark, str(path), 10, "2024-02-25 12:00:00")
    assert kept(spark, path) == sorted(r for r in rows if r[1] >= datetime(2024, 2, 15, 12))
    assert not [f for f in path.iterdir() if f.name.startswith(("_kept", "_retired"))]


@pytest.mark.parametrize("broken_at", range(4))
def test_a_crash_between_steps_loses_nothing(spark, tmp_path, monkeypatch, broken_at):
    path = tmp_path / "store"
    rows = store(spark, str(path))
    real, calls = IO._fs, [0]

    class Breaking:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            f = getattr(self.fs, name)
            if name not in ("rename", "delete"):
                return f

            def step(*args):
                calls[0] += 1
                if calls[0] > broken_at:
                    raise RuntimeError("lost")
                return f(*args)

            return step

    def fs(*args):
        found, at = real(*args)
        return Breaking(found), at

    monkeypatch.setattr(IO, "_fs", fs)
    with pytest.raises(RuntimeError):
        IO.retain(spark, str(path), 10, "2024-02-25 12:00:00")
    monkeypatch.setattr(IO, "_fs", real)
    IO.recover_store(spark, str(path))
    need = {r for r in rows if r[1] >= datetime(2024, 2, 15, 12)}
    assert need <= set(kept(spark, path)) <= set(rows)
    IO.retain(spark, str(path), 10, "2024-02-25 12:00:00")
    assert kept(spark, path) == sorted(need)
