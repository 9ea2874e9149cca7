"""Keys of any size: as-of joins, row frames and running sums in buckets and blocks give the rows of the plain forms, and no task holds a hot key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickspark.functions import blocks as K
from tickspark.operators import pit, technical

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def hot(spark):
    """One entity has nine of ten rows; ties in time, a null entity, nulls in values."""
    rng = random.Random(2)
    pick = lambda: 1 if rng.random() < 0.9 else rng.choice([2, 3, None])
    at = lambda: T0 + timedelta(seconds=rng.randrange(40_000))
    entities = spark.createDataFrame([(pick(), at(), k) for k in range(4000)], "entity_id int, ts timestamp_ntz, seq int")
    rows = [(pick(), rng.choice("pq"), t, None if rng.random() < 0.1 else round(rng.random(), 6), t + timedelta(seconds=k)) for k, t in enumerate(at() for _ in range(3000))]
    features = spark.createDataFrame(rows, "entity_id int, feature_name string, ts timestamp_ntz, value double, created_at timestamp_ntz")
    return entities, features


def brute_as_of(entities, features, names, max_age=None):
    found = {}
    for e, n, t, v, c in sorted((tuple(r) for r in features.collect()), key=lambda r: (r[2], r[4])):
        found.setdefault((e, n), []).append((t, v))
    out = set()
    for e, t, s in (tuple(r) for r in entities.collect()):
        cells = []
        for n in names:
            seen = [x for x in found.get((e, n), []) if x[0] <= t]
            ok = seen and (max_age is None or (t - seen[-1][0]).total_seconds() <= max_age)
            cells.append(seen[-1][1] if ok else None)
        out.add((e, t, s, *cells))
    return out


@pytest.mark.parametrize("max_age", [None, 120.0])
def test_as_of_join_of_a_hot_entity(hot, max_age):
    entities, features = hot
    got = pit.point_in_time_join(entities, features, ["p", "q", "none"], max_age, entity_rows=200)
    assert {tuple(r) for r in got.collect()} == brute_as_of(entities, features, ["p", "q", "none"], max_age)
    assert got.count() == entities.count()


def test_no_task_holds_more_than_a_bucket(hot):
    entities, _ = hot
    cuts = K.time_cuts(entities, "ts", 40)
    sizes = K.with_bucket(entities, K.micros("ts"), cuts, "b").groupBy("entity_id", "b").count()
    assert sizes.agg(F.max("count")).first()[0] < 4000 * 0.9 / 40 * 2
    plan = pit.point_in_time_join(*hot, ["p"], entity_rows=200)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_k" in plan and "_bucket" in plan.split("Window", 1)[1]


def test_running_sums_and_positions(hot):
    entities, _ = hot
    cuts = K.time_cuts(entities, "ts", 30)
    value = F.when(F.col("seq") % 7 != 0, F.col("seq"))
    got = K.ranked(K.carried(entities, ["entity_id"], ["ts", "seq"], {"s": value}, cuts), ["entity_id"], ["ts", "seq"], cuts)
    state, want = {}, set()
    for e, t, s in sorted((tuple(r) for r in entities.collect()), key=lambda r: r[1:]):
        n, total = state.get(e, (0, None))
        total = total if s % 7 == 0 else (total or 0) + s
        want.add((e, s, total, n))
        state[e] = (n + 1, total)
    assert {(r.entity_id, r.seq, r.s, r._rank) for r in got.collect()} == want


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(4)
    rows = []
    for symbol, n in ((7, 900), (8, 60), (None, 40)):
        p = 100.0
        for k in range(n):
            p *= 1 + rng.uniform(-0.02, 0.02)
            rows.append((symbol, T0 + timedelta(days=k), p, p * 1.01, p * 0.99, None if rng.random() < 0.03 else p * 1.001, float(rng.randrange(5))))
    return spark.createDataFrame(rows, "symbol int, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def rounded_rows(df, cols):
    return {tuple(None if v is None else round(v, 7) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()}


def test_blocks_of_rows_give_the_same_features(bars):
    whole = technical.technical_all(bars)
    cut = technical.technical_all(bars, block_rows=50)
    assert sorted(cut.columns) == sorted(whole.columns) and cut.count() == 1000
    assert rounded_rows(cut, whole.columns) == rounded_rows(whole, whole.columns)
    # later rows count as well
    label = lambda d, by: technical.forward_label(d, 5, by=by)
    assert rounded_rows(K.in_blocks(bars, label, ["symbol"], ["ts"], 0, 5, 50), ["symbol", "ts", "label"]) == rounded_rows(technical.forward_label(bars, 5), ["symbol", "ts", "label"])


def test_a_block_is_no_longer_than_its_rows_and_halo(bars):
    seen = {}

    def build(d, by):
        seen["most"] = d.groupBy(*by).count().agg(F.max("count")).first()[0]
        return d

    assert K.in_blocks(bars, build, ["symbol"], ["ts"], 21, 5, 50).count() == 1000
    assert seen["most"] == 50 + 21 + 5
    with pytest.raises(ValueError):
        K.in_blocks(bars, build, ["symbol"], ["ts"], 60, 0, 50)


def test_time_blocks_give_the_same_trailing_features(hot):
    ticks = hot[0].selectExpr("entity_id symbol", "ts", "seq", "seq * 0.5D price", "cast(seq % 9 as double) size", "if(seq % 2 = 0, 'B', 'A') side")
    build = lambda d, by: technical.trailing_features(d, 60, by)
    got = K.in_time_blocks(ticks, build, ["symbol"], "ts", 60, block_rows=100)
    want = build(ticks, ("symbol",))
    assert rounded_rows(got, want.columns) == rounded_rows(want, want.columns) and got.count() == ticks.count()


def test_empty_tables(spark, bars):
    assert technical.technical_all(bars.limit(0), block_rows=50).count() == 0
    e = spark.createDataFrame([], "entity_id int, ts timestamp_ntz")
    f = spark.createDataFrame([], "entity_id int, feature_name string, ts timestamp_ntz, value double, created_at timestamp_ntz")
    assert pit.point_in_time_join(e, f, ["p"], entity_rows=1).count() == 0
