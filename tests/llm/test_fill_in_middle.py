"""Fill-in-the-middle rows against a plain loop over code points."""

import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tickspark.llm import fill_in_middle as M
from tickspark.llm.queries import op13_fill_in_middle


def brute(doc_id, text, apply_pct=90, spm_pct=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= apply_pct:
        return n, "plain", None, None, text
    pieces = {"P": text[:a], "M": text[a:b], "S": text[b:]}
    form = "spm" if h[3] % 100 < spm_pct else "psm"
    return n, form, a, b - a, "".join(f"<{k}>{pieces[k]}" for k in ("SPM" if form == "spm" else "PSM"))


ODD = [None, "", "x", "é中文😀", "a<P", "<P> stays plain", "<S", "S>M><M", "\0a\0b", "áë", "\n\r\t ", "<" * 40, "same", "same"]


def test_rows_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice("ab<>PSM é中😀") for _ in range(rng.randrange(60))) for _ in range(400)), "中a" * 30_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (None, None), (5, "a<P")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("taken") for c in ("n", "form", "output", "_first", "units")})
    got = M.transform(df).withColumn("back", M.restored()).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, *brute(i, t)) for i, t in rows), key=key)
    assert all(r.back == (r.text or "") and r.units == "taken" for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert M.transform(df.limit(0)).count() == 0


def test_texts_longer_than_a_run_are_whole(monkeypatch):
    monkeypatch.setattr(M, "AT_ONCE", 7)
    texts = ["", "0123456789é中文😀" * 5, "short", "x" * 7, "y" * 8]
    first, second = [0, 10, 2, 7, 3], [0, 40, 2, 7, 8]
    out = M._outputs(texts, pa.array(["plain", "psm", "spm", "psm", "spm"]), pa.array(first), pa.array(second)).to_pylist()
    p, m, s = zip(*((t[:a], t[a:b], t[b:]) for t, a, b in zip(texts, first, second)))
    assert out == ["", f"<P>{p[1]}<S>{s[1]}<M>{m[1]}", f"<S>{s[2]}<P>{p[2]}<M>{m[2]}", f"<P>{p[3]}<S>{s[3]}<M>{m[3]}", f"<S>{s[4]}<P>{p[4]}<M>{m[4]}"]


def test_shares_of_forms_are_parameters(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.form for r in M.transform(docs, apply_pct=50, spm_pct=50).collect()}
    assert got == {r.doc_id: brute(r.doc_id, r.text, 50, 50)[1] for r in docs.collect()}


def test_query_restores_every_text(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op13_fill_in_middle(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(brute(r.doc_id, texts[r.doc_id])[4].encode()).hexdigest()
