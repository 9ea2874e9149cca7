"""What the findings of round 3 showed: one small case each."""

import numpy as np
import pandas as pd

import corpus_pipeline
from tickspark.functions import scratch
from tickspark.llm import shingle_copies
from tickspark.plans import all_queries
from tickspark.sources import io


def test_matched_fills_keep_only_what_is_read_in_state(spark, small):
    """neither quantity nor price of a fill waits in the state, and the result has the two ids only."""
    before = len(scratch._MADE)
    all_queries()["st6_match_fills"](spark, small).count()
    made = {p.rsplit("/", 1)[1].rsplit("-", 1)[0]: p for p in scratch._MADE[before:]}
    state = spark.read.format("statestore").option("path", made["stream-state"]).option("joinSide", "left").load()
    assert not {"i_quantity", "i_price"} & set(state.schema["value"].dataType.names) and state.count() > 5000
    assert spark.read.parquet(made["stream-out"]).columns == ["i_fill_id", "x_fill_id"]


def test_pipeline_stage_compares_what_simhash_links(spark, small, monkeypatch):
    """groups of fingerprints within four bits are links of the stage; the exact similarity decides them."""
    found, links = [], shingle_copies.fingerprint_links
    monkeypatch.setattr(shingle_copies, "fingerprint_links", lambda *a: found.append(links(*a)) or found[0])
    long = "word and more " * 2_000
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(1, long), (2, long + "end"), (3, text), (4, text + " end"), (5, "quite another text")]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), small)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5]
    assert [tuple(r) for r in found[0].orderBy("hub").collect()] == [(0, 1), (2, 3)]


def test_light_values_have_one_file_and_all_tasks_write(spark, tmp_path):
    """Only heavy values are dealt over several files, light ones are not all written by one task; one symbol is read from its folder."""
    rows = spark.range(3000).selectExpr("case when id < 2000 then 0 else 1 + id % 100 end symbol", "id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) ts")
    path = str(tmp_path / "store")
    io.write_partitioned(rows, path, files=3, heavy=1000)
    files = {int(p.name.split("=")[1]): sorted(x.name for x in p.glob("*.parquet")) for p in (tmp_path / "store").glob("symbol=*")}
    assert len(files) == 101 and 1 < len(files.pop(0)) <= 3 and all(len(x) == 1 for x in files.values())
    assert len({x[0].split("-")[1] for x in files.values()}) > 1
    read = spark.read.parquet(path)
    assert read.count() == 3000 and set(read.columns) == {"symbol", "id", "ts"}
    one = io.read_ticks(spark, path, 7)
    assert [set(f.split("/")[-2] for f in one.inputFiles()), one.count(), one.filter("symbol = 7").count()] == [{"symbol=7"}, 10, 10]
    assert io.read_ticks(spark, path, 4444).count() == 0 and io.read_ticks(spark, path, 0, "2024-01-01 00:10:00", "2024-01-01 00:10:09").count() == 10


def test_pipeline_stage_leaves_no_files_of_its_exchanges(spark, small):
    """pipeline on check_h: some 170 exchanges of 211 partitions filled the disk with files that nothing read any more."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x for x in map(str, disk.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in x}
    before = held()
    rows = [(k, f"one two three four five six seven eight {k // 2}") for k in range(40)]
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(name)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), small)
    left = held() - before
    assert len(left) < 15 and spark.conf.get(name) == own and kept.count() == 20


def test_encoder_learns_less_and_gives_the_same_ids(monkeypatch):
    """op8: words after a line feed and words with any marks share what is learnt, and words that go on to occur are not learnt again."""
    import random

    import numpy as np
    import pyarrow as pa
    from tickspark.llm.queries import byte_bpe
    from tickspark.llm.text_ids import TextEncoder, load_tokenizer

    library, encoder, asked = load_tokenizer(byte_bpe()), TextEncoder(load_tokenizer(byte_bpe()), max_bytes=200 * 4), []
    whole = TextEncoder._whole
    monkeypatch.setattr(TextEncoder, "_whole", lambda self, texts: asked.extend(texts) or whole(self, texts))
    of = lambda texts: [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_rows(pa.array(texts))]
    truth = lambda texts: [library.encode(x, add_special_tokens=False).ids for x in texts]
    first = ["x alpha beta$$$ gamma.\nDelta", "x epsilon&&& zeta.\nEta"]
    assert of(first) == truth(first)
    asked.clear()
    second = ["x alpha beta&&& gamma.\nEta", "x zeta.\nDelta epsilon$$$"]
    assert of(second) == truth(second) and not any("alpha" in x or "gamma" in x or "Delta" in x for x in asked)
    pieces = ["a", "Ab", "é", "\n", "\n\n", " ", "  ", ".", "'s", "'", "$$", "<|endoftext|>", "7", "\t", "\r\n", "\x00", "\x00\n", "-"]
    draw = random.Random(3)
    odd = ["".join(draw.choices(pieces, k=draw.randint(0, 12))) for _ in range(3000)]
    assert of(odd) == truth(odd)


def test_many_short_keys_meet_one_call_of_the_strategy(spark, monkeypatch):
    """a strategy that takes key numbers sees whole keys of a stream at once; each key has the curve it has by itself."""
    from tickspark.operators import strategy as S

    rows = [(None if k == 7 else k, i, 10.0 + (i * (k + 3)) % 11, 0.0 if (k, i) == (5, 3) else 9.9 + (i * (k + 3)) % 11, 10.1 + (i * (k + 3)) % 11) for k in range(40) for i in range(k % 9 + 12)]
    bars = spark.createDataFrame(rows, "symbol long, ts long, close double, bid double, ask double").repartition(3)
    grid = S.param_grid(spark, {"lookback": [4], "entry": [0.5, 1.0]})
    alone = lambda t, params: S.threshold_strategy(t, params)
    together = lambda t, params, keys: S.threshold_strategy(t, params, keys) if len(set(keys)) > 1 else t.close * 0 + 99
    ordered = lambda df: [tuple(r) for r in df.orderBy(*df.columns[:3]).collect()]
    one, many = ordered(S.backtest(bars, grid, alone)), ordered(S.backtest(bars.coalesce(1), grid, together))
    assert one == many and len(one) == 2 * len(rows) and sum(r[1] is None for r in one) == 2 * (7 % 9 + 12)
    monkeypatch.setattr(S, "BARS_AT_ONCE", 10)
    assert ordered(S.backtest(bars, grid)) == one
    whole = {r.run: r for r in S.sweep(bars, grid).collect()}
    last = {r[:2]: r[5] for r in one}
    assert all(whole[k].trades == sum(r[6] for r in one if r[0] == k) for k in (0, 1)) and len(last) == 80


def test_regime_features_of_a_stream_are_those_of_frames(spark):
    """frames that begin in an earlier piece of the stream, nulls, series that do not vary or are short, a null key; no frame is gone through row by row."""
    from tickspark.operators import technical as T

    rng = np.random.default_rng(6)
    rows = [(k, i, None if (k, i) in ((1, 9), (2, 30)) else 0.25 if k == 4 else float(rng.normal())) for k in (None, 1, 2, 3, 4) for i in range(4 if k == 3 else 41)]
    df = spark.createDataFrame(rows, "symbol int, ts int, ret double").repartition(3)
    made = T.regime_features(df, 5, block_rows=7)
    assert "specifiedwindowframe(RowFrame, -4" not in made._jdf.queryExecution().analyzed().toString()
    got = {(r.symbol, r.ts): r for r in made.collect()}
    assert len(got) == len(rows)
    frame = pd.DataFrame(rows, columns=["symbol", "ts", "ret"])
    for symbol, t in frame.groupby("symbol", dropna=False):
        x = t.ret.to_numpy(float)
        for i in range(len(x)):
            r, w, p = got[None if symbol != symbol else symbol, i], x[max(0, i - 4) : i + 1], np.concatenate([[np.nan], x])[max(0, i - 4) : i + 1]
            if len(w) < 5 or np.isnan(w).any():
                assert (r.roll_std, r.roll_mean, r.roll_skew, r.roll_kurt, r.autocorr, r.slope) == (None,) * 6
                continue
            one = pd.Series(w)
            assert abs(r.roll_mean - one.mean()) < 1e-12 and abs(r.roll_std - one.std()) < 1e-12 and abs(r.slope - np.polyfit(range(5), w, 1)[0]) < 1e-12
            if symbol == 4:
                assert r.roll_std == 0 and (r.roll_skew, r.roll_kurt, r.autocorr) == (None,) * 3
            else:
                ok = ~np.isnan(p)
                assert abs(r.roll_skew - one.skew()) < 1e-9 and abs(r.roll_kurt - one.kurt()) < 1e-9 and abs(r.autocorr - np.corrcoef(w[ok], p[ok])[0, 1]) < 1e-9


def test_wavelet_levels_share_one_sort(spark):
    """blocks overlap by the reach of all levels, so that each block is sorted once."""
    from tickspark.operators import spectral as S

    rows = [(k, i, float((i * (k + 5)) % 17)) for k in (1, 2) for i in range(130)]
    df = spark.createDataFrame(rows, "symbol int, ts int, close double")
    made = S.wavelet_bank(df, block_rows=50)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [symbol") == 2 and "aggregate(" not in plan
    assert made.count() == len(rows)
