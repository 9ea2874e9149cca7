"""Options, user-defined parts and models that no registered query runs, against plain recomputation."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickspark.functions import scratch
from tickspark.functions.quantiles import exact_quantiles
from tickspark.operators import bars, clean, ledger, ml, pit, strategy
from tickspark.sources import io, wire
from tickspark.streaming import streams

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"symbol": np.repeat([1, 2], 40), "ts": [START + timedelta(days=int(i)) for i in range(40)] * 2, "close": np.round(rng.normal(50, 5, 80), 3)})
    data.loc[[7, 55], "close"] = [400.0, np.nan]
    rows = [(int(s), t.to_pydatetime(), None if c != c else float(c)) for s, t, c in data.itertuples(index=False)]
    return data, spark.createDataFrame(rows, "symbol long, ts timestamp_ntz, close double")


def values(df, name):
    return np.array([np.nan if r[0] is None else r[0] for r in df.orderBy("symbol", "ts").select(name).collect()], float)


def test_cleaning_options(frame):
    data, df = frame
    by = data.groupby("symbol")["close"]
    low, high = by.transform(lambda x: x.quantile(0.01)), by.transform(lambda x: x.quantile(0.99))
    assert np.allclose(values(clean.cap_outliers(df, ["close"], "quantile"), "close"), data.close.clip(low, high), equal_nan=True)
    assert np.allclose(values(clean.normalize(df, ["close"], "minmax"), "close"), by.transform(lambda x: (x - x.min()) / (x.max() - x.min())), equal_nan=True)
    assert clean.fill_missing(df, ["close"], "drop").count() == 79
    assert np.allclose(values(clean.fill_missing(df, ["close"], "median"), "close"), data.close.fillna(data.close.median()))
    reach = by.agg(lambda x: ((x < x.quantile(0.25) - 3 * (x.quantile(0.75) - x.quantile(0.25))) | (x > x.quantile(0.75) + 3 * (x.quantile(0.75) - x.quantile(0.25)))).sum())
    assert {r.symbol: r.outliers for r in bars.outlier_report(df, "close", "iqr").collect()} == reach.to_dict()


@pytest.mark.parametrize("method", ["mse", "variance", "posterior"])
def test_ensemble_weights(spark, method):
    rng = np.random.default_rng(1)
    y = rng.normal(size=60)
    p = pd.DataFrame({"k": range(60), "a": y + rng.normal(0, 0.2, 60), "b": y + rng.normal(0.1, 0.3, 60), "y": y})
    e = {m: p[m] - p.y for m in "ab"}
    raw = {"mse": lambda x: 1 / (x**2).mean(), "variance": lambda x: 1 / x.var(), "posterior": lambda x: -0.5 * len(x) * np.log((x**2).mean())}[method]
    v = np.array([raw(e[m]) for m in "ab"])
    v = np.exp(v - v.max()) if method == "posterior" else v
    got = {r.model: r.weight for r in ml.ensemble_weights(spark.createDataFrame(p), ["a", "b"], "y", method).collect()}
    assert np.allclose([got["a"], got["b"]], v / v.sum())


def test_sequences_with_several_targets(frame):
    data, df = frame
    rows = ml.sequences(df.filter("symbol = 1"), ["close"], 3, "close", horizon=2, order=("ts",)).orderBy("ts").collect()
    x = data.close[:40].tolist()
    assert [(np.ravel(r.x).tolist(), list(r.y)) for r in rows] == [(x[i - 2 : i + 1], x[i + 1 : i + 3]) for i in range(2, 38)]


def test_random_parameters(spark):
    got = strategy.param_random(spark, {"a": (1, 2), "b": (-5, 5)}, 200, 3).collect()
    assert [r.params for r in got] == [r.params for r in strategy.param_random(spark, {"a": (1, 2), "b": (-5, 5)}, 200, 3).collect()]
    a, b = (np.array([r.params[k] for r in got]) for k in "ab")
    assert a.min() >= 1 and a.max() < 2 and b.min() >= -5 and b.max() < 5 and abs(a.mean() - 1.5) < 0.1 and abs(np.corrcoef(a, b)[0, 1]) < 0.25


def test_boosted_trees_and_their_search(spark):
    rng = np.random.default_rng(2)
    x = pd.DataFrame({"a": rng.normal(size=300), "b": rng.normal(size=300)})
    df = spark.createDataFrame(x.assign(y=3 * (x.a > 0) + 0.01 * x.b))
    model, r2, weight = ml.fit_gbt(df, ["a", "b"], "y", maxIter=5, maxDepth=2)
    got = np.array([r.prediction for r in model.transform(df).orderBy("a").select("prediction").collect()])
    y = (3 * (x.a > 0) + 0.01 * x.b)[x.a.argsort()].to_numpy()
    assert abs(r2 - (1 - ((got - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-6 and r2 > 0.95 and weight["a"] > 0.9
    _, searched, _ = ml.fit_gbt(df, ["a", "b"], "y", folds=2, grid={"maxDepth": [1, 2]}, maxIter=3)
    assert searched > 0.9
    table = spark.createDataFrame(list(weight.items()), "feature string, importance double")
    assert [r.feature for r in ml.top_features(table, 1).collect()] == ["a"]


def counted(df, seen):
    """The rows, which are counted each time they are made."""

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema)


def test_training_reads_its_input_once_in_parts_of_bounded_rows(spark, monkeypatch):
    df = spark.range(2000, numPartitions=1).selectExpr("cast(id % 7 as double) a", "cast(id % 3 as double) b", "cast(id % 7 as double) y", "id other")
    seen, sizes, keep = spark.sparkContext.accumulator(0), [], type(df).repartition
    monkeypatch.setattr(ml, "TASK_ROWS", 100)
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *c: sizes.append(n) or keep(self, n, *c))
    _, r2, weight = ml.fit_gbt(counted(df, seen), ["a", "b"], "y", maxIter=2, maxDepth=3)
    assert seen.value == 2000 and sizes == [20] and r2 > 0.9 and weight["a"] > 0.9


def test_clusters_read_their_input_once(spark):
    df = spark.range(900, numPartitions=1).selectExpr("cast(id % 3 as double) u", "cast(id % 2 as double) v")
    seen = spark.sparkContext.accumulator(0)
    assert ml.kmeans_regimes(counted(df, seen), ["u", "v"], 3).count() == 900 and seen.value == 900


def test_clusters_are_found(spark):
    rng = np.random.default_rng(4)
    centre = np.repeat([[0, 0], [10, 0], [0, 10]], 30, axis=0)
    df = spark.createDataFrame(pd.DataFrame(centre + rng.normal(0, 0.3, (90, 2)), columns=["u", "v"]).assign(own=np.repeat([0, 1, 2], 30)))
    got = ml.kmeans_regimes(df, ["u", "v"], 3).groupBy("own").agg(F.countDistinct("regime").alias("n"), F.first("regime").alias("r")).collect()
    assert all(r.n == 1 for r in got) and len({r.r for r in got}) == 3


def test_user_defined_risk_check(spark):
    orders = spark.createDataFrame([(k, 1, START, 10.0, 1.0, 1.0, 1, k) for k in range(4)], "order_id long, entity long, ts timestamp_ntz, quantity double, price double, ref_price double, rate long, desk long")
    state = spark.createDataFrame([(1, 0.0, 1e6, 1e6, 0.0, 0.0, False)], "entity long, position double, equity double, peak_equity double, daily_pnl double, gross double, killed boolean")
    limits = {"rate": 10, "notional": 1e3, "deviation": 0.1, "position": 100, "daily_loss": 50, "drawdown": 0.2, "leverage": 1.5}
    got = strategy.screen_orders(orders, state, limits, [(F.col("desk") == 2, "reject", "closed_desk")]).orderBy("order_id").collect()
    assert [(r.decision, r.reason) for r in got] == [("accept", None), ("accept", None), ("reject", "closed_desk"), ("accept", None)]


def test_registry_search_and_groups():
    reg = pit.FeatureRegistry()
    reg.register("ret_1", lambda d: d, group="returns")
    reg.register("ret_5", lambda d: d, group="returns")
    reg.register("Volume_mean", lambda d: d)
    assert reg.search("RET") == ["ret_1", "ret_5"] and reg.search("vol") == ["Volume_mean"] and reg.in_group("returns") == ["ret_1", "ret_5"] and reg.in_group("none") == []


def test_stale_values_go(spark):
    store = spark.createDataFrame([(1, START, 1.0), (2, START - timedelta(days=3), 2.0)], "entity_id long, ts timestamp, value double")
    assert [r.entity_id for r in streams.evict_stale(store, "2024-01-02 00:00:00", 2 * 86400).collect()] == [1]


def test_online_store_over_epochs(spark, tmp_path):
    """Many small batches, an epoch of three: the store holds the latest value of every entity."""
    source, want = str(tmp_path / "in"), {}
    for k in range(8):
        rows = [(e, "f", float(10 * k + e), START + timedelta(hours=k)) for e in (k % 3, 5)]
        want |= {r[0]: r[2] for r in rows}
        spark.createDataFrame(rows, "entity_id long, feature_name string, value double, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("entity_id long, feature_name string, value double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        streams.online_store_upsert(stream, str(tmp_path / "out"), str(tmp_path / "state"), every=3).awaitTermination()
    assert {r.entity_id: r.value for r in streams.online_store(spark, str(tmp_path / "out")).collect()} == want
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["epoch=1", "epoch=2"]


def test_jdbc_options_reach_the_reader(monkeypatch):
    seen = {}

    class Reader:
        def jdbc(self, *a, **k):
            seen.update(url=a[0], table=a[1], **k)
            return "rows"

    class Session:
        read = Reader()

    assert io.read_jdbc(Session(), "jdbc:x", "ticks", "id", 0, 100, 8, driver="d", fetchsize="1000") == "rows"
    assert seen == {"url": "jdbc:x", "table": "ticks", "column": "id", "lowerBound": 0, "upperBound": 100, "numPartitions": 8, "properties": {"driver": "d", "fetchsize": "1000"}}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        scratch.scratch_path(Session(), "x")
    path = scratch.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    scratch.remove_path(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def arrived(rows_a, rows_x):
    """The rule of arrival, fill by fill: (time, fill_id, quantity, price) of one key and both sides."""
    out, waiting = set(), ([], [])
    for t, theirs, f, q, v in sorted([(t, 0, f, q, v) for t, f, q, v in rows_a] + [(t, 1, f, q, v) for t, f, q, v in rows_x]):
        other, result = waiting[1 - theirs], None
        if other:
            u, g, r, w = other[0]
            result = "quantity" if abs(q - r) > 0.001 else "price" if abs(v - w) > 0.01 else "timestamp_drift" if abs((t - u).total_seconds()) > 1 else "matched"
            out.add((g, f, result) if theirs else (f, g, result))
        if result == "matched":
            other.pop(0)
        else:
            waiting[theirs].append((t, f, q, v))
    return out


def fills(spark, rows):
    df = spark.createDataFrame(rows, "fill_id string, order_id long, ts timestamp_ntz, quantity double, price double")
    return df.withColumns({"symbol": F.lit(1), "side": F.lit("buy"), "venue": F.lit("v")})


def test_matching_in_order_of_arrival_by_brute_force(spark):
    """Random keys with several fills a side, against the rule applied fill by fill; a null key is a key."""
    rng = np.random.default_rng(9)
    at = lambda: START + timedelta(seconds=int(rng.integers(0, 4)))
    key = lambda: None if (k := int(rng.integers(0, 12))) == 11 else k
    rows = {p: [(f"{p}{k:03d}", key(), at(), float(rng.choice([5, 5, 7])), float(rng.choice([1.0, 1.0, 1.0, 2.0]))) for k in range(120)] for p in "ax"}
    want = set()
    for k in [*range(11), None]:
        want |= arrived(*([(t, f, q, v) for f, own, t, q, v in rows[p] if own == k] for p in "ax"))
    got = [tuple(r) for r in ledger.match_fills(fills(spark, rows["a"]), fills(spark, rows["x"])).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {r for *_, r in want} == {"quantity", "price", "timestamp_drift", "matched"}


def test_a_fill_is_compared_when_it_arrives(spark):
    """Internal 5 at 0 ms and 7 at 100 ms, exchange 7 at 200 ms: one break with the first, nothing matched."""
    ms = lambda k: START + timedelta(milliseconds=k)
    a = fills(spark, [("a1", 1, ms(0), 5.0, 1.0), ("a2", 1, ms(100), 7.0, 1.0)])
    x = fills(spark, [("x1", 1, ms(200), 7.0, 1.0)])
    assert [tuple(r) for r in ledger.match_fills(a, x).collect()] == [("a1", "x1", "quantity")]
    # both stand open, and the matcher is in the plan once
    missing = ledger.missing_fills(a, x, ledger.match_fills(a, x), "2030-01-01 00:00:00")
    assert {(r.fill_id, r.kind) for r in missing.collect()} == {("a1", "missing_exchange"), ("a2", "missing_exchange"), ("x1", "missing_internal")}
    assert missing._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_null_keys_are_one_key_in_folds(spark):
    rows = [(None, 1, START + timedelta(seconds=k), f"f{k}", "buy", 2.0, 10.0) for k in range(3)]
    trades = spark.createDataFrame(rows, "account int, symbol int, ts timestamp_ntz, fill_id string, side string, quantity double, price double")
    assert [r.position for r in ledger.position_state(trades).orderBy("ts").collect()] == [2.0, 4.0, 6.0]


def test_exact_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"g": rng.integers(0, 3, 3000), "v": np.round(rng.lognormal(0, 1, 3000), 2)})
    p.loc[:900, "v"] = 1.0  # many ties
    df = spark.createDataFrame(p).unionByName(spark.createDataFrame([(0, None), (9, None), (7, 2.5)], "g long, v double"))
    probs = {"low": 0.05, "mid": 0.5, "high": 0.99, "least": 0.0, "most": 1.0}
    got = {r.g: r for r in exact_quantiles(df, "v", probs, ["g"]).collect()}
    assert set(got) == {0, 1, 2, 7} and got[7].mid == 2.5
    for g, part in p.groupby("g"):
        assert all(abs(got[g][k] - part.v.quantile(q)) < 1e-9 for k, q in probs.items())
    assert abs(exact_quantiles(df, "v", {"mid": 0.5}, []).first().mid - pd.concat([p.v, pd.Series([2.5])]).median()) < 1e-9
    assert exact_quantiles(df.limit(0), "v", probs, ["g"]).count() == 0


def test_binary_messages_of_all_types(spark):
    head = lambda kind, ref=7: kind.encode() + (123456789012).to_bytes(6, "big") + ref.to_bytes(8, "big")
    n = lambda x, k=4: x.to_bytes(k, "big")
    rows = [
        head("A") + b"B" + n(100) + b"ABC     " + n(1234500), head("F") + b"S" + n(5) + b"WXYZ1234" + n(10000) + b"MPID", head("E") + n(30) + n(9, 8), head("C") + n(31) + n(9, 8) + b"Y" + n(55000),
        head("X") + n(12), head("D"), head("U") + n(99, 8) + n(40) + n(20000), b"S" + n(5, 6) + b"O" + n(0), b"Z" + bytes(40), b"A", b"", None,
    ]
    got = [tuple(r) for r in wire.decode_itch(spark.createDataFrame([(None if r is None else bytearray(r),) for r in rows], "data binary").coalesce(1)).collect()]
    t = 123456789012
    assert got == [
        ("A", t, 7, "B", 100, "ABC", 123.45, None), ("F", t, 7, "S", 5, "WXYZ1234", 1.0, None), ("E", t, 7, None, 30, None, None, None), ("C", t, 7, None, 31, None, 5.5, None),
        ("X", t, 7, None, 12, None, None, None), ("D", t, 7, None, None, None, None, None), ("U", t, 7, None, 40, None, 2.0, 99), ("S", 5, None, "O", None, None, None, None),
    ]
