import random
import re

import corpus_pipeline as C
import numpy as np
from tickspark.llm import shingle_copies as S
from tickspark.llm.shingle_copies import near_copy_groups
from tickspark.llm.shingle_hash import fingerprints

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return {(d, least.get(find(i))) for i, (d, _) in enumerate(rows)}


def copies(seed=3):
    """Texts with near copies on both sides of the bound, most of them over four bits apart."""
    rng, rows = random.Random(seed), []
    for _ in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 300))]
        rows.append(" ".join(words))
        for _ in range(4):
            other = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) * rng.randrange(1, 6) // 100)):
                other[at] = f"x{rng.randrange(9999)}"
            rows.append(" ".join(other))
    return list(enumerate(rows))


def test_groups_against_brute_force(spark, small):
    rows = copies() + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(5000, None), (5001, " \n"), (None, rows[0][1]), (5002, "One two"), (5003, "one\ttwo"), (None, "only here now")]
    got = near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute_groups(rows) and got.count() == len(rows)


def test_pipeline_stage_drops_copies_over_four_bits_apart(spark, small):
    rows = copies()
    want = {d for d, root in brute_groups(rows) if d == root}
    bits = fingerprints([t for _, t in rows])
    groups = dict(brute_groups(rows))
    assert any((int(bits[d]) ^ int(bits[root])).bit_count() > 4 for d, root in groups.items())
    kept = C.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), small)
    assert {r.doc_id for r in kept.collect()} == want
    assert near_copy_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stage_decides_by_row(spark, small):
    """Repeated rows, ids under different texts, null ids, empty and long texts, columns that clash with names used inside."""
    a, b, c, long = ("a b c d e f g", "h i j k l m n", "o p q r s t u", "w " * 200_000)
    rows = [(1, a), (1, a), (2, b), (3, b), (3, c), (None, b), (None, "only here now"), (None, "only here now"), (8, None), (7, " "), (9, ""), (11, long), (10, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as num", "2 as node", "3 as `row`", "4 as `a.b`", "5 as id", "6 as keys")
    kept = C.drop_near_duplicates(spark, docs, small)
    assert kept.columns == docs.columns
    want = [(1, a), (2, b), (3, c), (None, "only here now"), (7, " "), (10, long)]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((d or 0, t) for d, t in want)
    assert C.drop_near_duplicates(spark, docs.limit(0), small).count() == 0


def test_counts_in_common():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 5, 30, 30, 80)]
    for columns in (3, 4096):
        got = S.shared_counts(sets[:4], sets[2:], columns)
        assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[2:]] for x in sets[:4]]
    assert S.shared_counts([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]).tolist() == [[0]]


def test_large_keys_are_cut_into_blocks(spark, monkeypatch):
    """Chains of near copies whose ends are far apart, all under one key: every link between blocks counts."""
    monkeypatch.setattr(S, "KEY_BLOCK", 4)
    rng = random.Random(6)
    texts = []
    for _ in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for step in range(8):
            texts.append(" ".join(words))
            words[step * 14] = f"x{rng.randrange(9999)}"
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    mixed = frame.selectExpr("7L key", "node", "node root").unionByName(frame.filter("node < 3").selectExpr("8L key", "node", "0L root"))
    links = [tuple(r) for r in S.key_links(mixed, frame, 5, 0.8).collect()]
    sets = [shingles(t) for t in texts]
    near = lambda x, y: 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])
    groups = dict(brute_groups(list(enumerate(texts))))
    assert len(set(groups.values())) == 6 and not near(0, 7)
    parent = list(range(len(texts)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for x, y in links:
        parent[find(x)] = find(y)
    assert {frozenset(k for k in range(48) if find(k) == r) for r in {find(k) for k in range(48)}} == {frozenset(k for k in range(48) if groups[k] == g) for g in set(groups.values())}
