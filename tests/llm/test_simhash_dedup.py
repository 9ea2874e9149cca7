import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickspark.llm import golay
from tickspark.llm.components import connected_components
from tickspark.llm.shingle_hash import fingerprints
from tickspark.llm.simhash_dedup import near_duplicate_groups, near_pairs

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute_fingerprint(text: str) -> int:
    data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()
    words = WORD.findall(data)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [brute_fingerprint(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, prints[i], least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_golay_decodes_three_errors_and_indices_meet():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 300)
    near = golay.indices(words)
    for bits in [(i,) for i in range(23)] + list(combinations(range(23), 2)):
        other = words ^ sum(1 << b for b in bits)
        sets = golay.indices(other)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(near, sets))
        if len(bits) == 1:
            assert all(d in set(a) for d, a in zip(golay.decode(other), near))


def test_fingerprints_equal_the_plain_rule(spark, small):
    texts = ["", " \n", "a", "A b", "a\n\tb c  D e", " x é ", "w" * 90 + " b c d " * 40, "", "one two three four"]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    assert fingerprints(texts).tolist() == [brute_fingerprint(t) for t in texts]
    assert len(fingerprints([])) == 0


def test_near_pairs_finds_every_pair(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for x in list(prints):
        for n in range(1, 7):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), n)))
    want = {tuple(sorted(np.array(p, np.uint64).view(np.int64).tolist())) for p in combinations(prints, 2) if (p[0] ^ p[1]).bit_count() <= 4}
    rows = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    got = near_pairs(spark.createDataFrame([(x,) for x in rows], "fp long"))
    assert {(r.a, r.b) for r in got.collect()} == want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (60, 61)]
    got = {(r.node, r.root) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 1) for k in range(1, 41)} | {(k, 100) for k in range(100, 160)} | {(60, 60), (61, 60)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").limit(80).collect()]
    long = rows[3][1] * 30
    rows += [(1000, None), (1001, ""), (None, "\t"), (1002, long), (1003, long + " x"), (1004, long + " y z"), (1002, long), (None, "only here now")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("id", F.lit(1))
    got = [(r.id, r.fp % (1 << 64), r.component_id) for r in near_duplicate_groups(frame).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(brute_groups(rows), key=key)


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty_table(spark, schema):
    assert near_duplicate_groups(spark.createDataFrame([], schema)).count() == 0
