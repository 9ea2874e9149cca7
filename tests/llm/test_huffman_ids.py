import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickspark.llm import huffman_ids as H
from tickspark.llm.queries import byte_bpe
from tickspark.llm.text_ids import TextEncoder, load_tokenizer

ODD = ["", " ", "   ", "a   b", "it's 12x I'LL 's don't", " \n x", "\n \n y", "café ²x", "<|endoftext|> hi", "a <|endoftext|>", " a", "a ", "a \n \n", "　d  e", "x" * 5000, "\U0001f600 жз"]


@pytest.fixture(scope="module")
def plain():
    return load_tokenizer(byte_bpe())


def ids_of(plain, text):
    return plain.encode(text, add_special_tokens=False).ids


def test_pieced_encoding_equals_the_library(plain, spark, small):
    texts = ODD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()]
    coder = TextEncoder(plain, max_bytes=10_000)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode_rows(pa.array(texts), max_bytes=3000)]
        assert got == [ids_of(plain, t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=" \n\t'stre12.,éß中", max_size=40))
def test_pieced_encoding_of_odd_texts(text):
    tokenizer = load_tokenizer(byte_bpe())
    got = [np.frombuffer(x, "<u4").tolist() for x in TextEncoder(tokenizer).encode_rows(pa.array([text, "b " + text + " b"]))]
    assert got == [ids_of(tokenizer, text), ids_of(tokenizer, "b " + text + " b")]


def brute_best_cost(counts, bits):
    """Least cost of code lengths up to `bits` by search over Kraft sums (small inputs)."""
    counts = sorted(counts, reverse=True)
    states = {0: 0}
    for c in counts:
        new = {}
        for kraft, cost in states.items():
            for n in range(1, bits + 1):
                k = kraft + (1 << (bits - n))
                if k <= 1 << bits and (k not in new or new[k] > cost + n * c):
                    new[k] = cost + n * c
        states = new
    return min(states.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=2, max_size=8), st.integers(3, 6))
def test_lengths_are_optimal_within_the_limit(counts, bits):
    lengths = H.code_lengths(np.array(counts), bits)
    assert lengths.max() <= bits and sum(2.0 ** -lengths.astype(float)) <= 1
    assert int((lengths.astype(int) * counts).sum()) == brute_best_cost(counts, bits)


def test_blocks_decode_to_what_was_coded():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1024, 1025, 5000):
        ids = np.minimum(rng.geometric(0.01, n), 999)
        coder = H.Coder(H.code_lengths(np.bincount(ids, minlength=1000) if n else np.ones(3, int)))
        back, docs = coder.decode(coder.encode(ids, np.array([n])))
        assert back.tolist() == ids.tolist() and docs.tolist() == [n]


def test_files_hold_every_document_in_order(spark, small, tmp_path, plain):
    import zlib

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    rows += [(5000 - i, t) for i, t in enumerate(ODD)] + [(7000, "repeated")] * 30 + [(None, "no id"), (9000, None), (9001, "same"), (9002, "same")]
    H.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), byte_bpe(), str(tmp_path / "f"))
    got = sorted(H.read_ids(spark, str(tmp_path / "f"), texts=True).collect(), key=lambda r: r.start)
    at = 0
    for r, (name, text) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0])), strict=True):
        want = [*ids_of(plain, text or ""), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (name, at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_empty_table(spark, tmp_path):
    H.write_ids(spark.createDataFrame([], "doc_id long, text string"), byte_bpe(), str(tmp_path / "e"))
    assert H.read_ids(spark, str(tmp_path / "e")).count() == 0
