"""Near copies by the exact similarity of their word shingles.

Candidates share a band of min-wise hashes, links are verified by the Jaccard similarity of the whole shingle sets.
With 60 bands of eight hashes a pair at similarity 0.8 shares none with a chance below 2e-5, a closer pair with less.
Texts with one shingle set (128-bit digests) meet as one node.  A pair is compared in a stream that holds
the shingles of one end, the hub, while the texts of the other ends pass, so that a hub's text moves once for some hundred pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ._common import checkpoint, clear_scratch, join_hot, materialise, scratch_mark, shuffles_removed, slices, small_batches, whole_text
from .components import connected_components
from .shingle_hash import shingle_hashes
from .simhash_dedup import near_duplicate_groups

BANDS, ROWS = 60, 8
_RNG = np.random.default_rng(20)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if not texts:
        return []
    h, _, n = shingle_hashes(texts, words)
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(set, band) keys of non-empty sets."""
    keys = np.empty((len(sets), BANDS), np.uint64)
    # so few hashes at a time that they stay in the processor's cache
    sizes = np.array([len(x) for x in sets])
    for a, b in _runs(sizes, 16_384):
        h, starts = np.concatenate(sets[a:b]), np.cumsum(sizes[a:b]) - sizes[a:b]
        mixed, least = np.empty_like(h), np.empty((BANDS * ROWS, b - a), np.uint64)
        for k in range(BANDS * ROWS):
            np.bitwise_xor(h, _FLIP[k], out=mixed)
            np.multiply(mixed, _TIMES[k], out=mixed)
            least[k] = np.minimum.reduceat(mixed, starts)
        for band in range(BANDS):
            key = np.full(b - a, np.uint64(band))
            for part, times in zip(least[band * ROWS : band * ROWS + ROWS], _MIX[band]):
                key = (key ^ part) * times
                key ^= key >> np.uint64(31)
            keys[a:b, band] = key
    return keys


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def add_bands(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(num, id, high, low, keys, row) of each row: num is unique, high and low are the digest of the shingle set, row holds all columns; keys are empty for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, 512, 2_000_000):
                sets = shingle_sets(texts[a:b], words)
                digest = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), "<i8").reshape(-1, 2)
                full = [x for x in sets if len(x)]
                found = iter(band_keys(full).view(np.int64) if full else ())
                keys = [next(found) if len(x) else np.zeros(0, np.int64) for x in sets]
                own = [batch.column(k).slice(a, b - a) for k in (0, 1, 3)]
                columns = [*own[:2], pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(keys, pa.list_(pa.int64())), own[2]]
                yield pa.RecordBatch.from_arrays(columns, names=["num", "id", "high", "low", "keys", "row"])

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    source = docs.select(F.monotonically_increasing_id().alias("num"), F.col(id_col).cast("long").alias("id"), whole_text(F.col(text_col)).alias("text"), row.alias("row"))
    schema = StructType().add("num", "long").add("id", "long").add("high", "long").add("low", "long").add("keys", ArrayType(LongType())).add(source.schema["row"])
    return source.mapInArrow(run, schema)


#: Pairs of one hub that a task compares; a hub with more of them is sent to several tasks.
PAIRS_A_HUB = 256


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of the (hub, node) rows, the (a, b), a < b, whose shingle sets have at least that Jaccard similarity; texts has (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = np.zeros(0, np.uint64)
        for batch in batches:
            hubs, nodes, member = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            texts = batch.column(4).to_pylist()
            kept = []
            for a, b in slices(texts, 512, 2_000_000):
                for k, q in zip(range(a, b), shingle_sets(texts[a:b], words)):
                    if not member[k]:
                        p = q  # the rows of a hub's part follow it
                        continue
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if both >= similarity * (len(p) + len(q) - both) - 1e-9:
                        kept.append(k)
            x, y = hubs[kept], nodes[kept]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    parts = F.ceil(F.col("n") / PAIRS_A_HUB).cast("int")
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    members = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", F.lit(True).alias("member"))
    heads = sizes.select("hub", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("hub").alias("node"), F.lit(False).alias("member"))
    moved = members.unionByName(heads).join(texts, "node").select("hub", "part", "node", "member", "text")
    return moved.repartition("hub", "part").sortWithinPartitions("hub", "part", "member").mapInArrow(run, "a long, b long")


def hub_pairs(shared: DataFrame) -> DataFrame:
    """(hub, node): the nodes of each key with the key's hub.

    Hub is the node that shares the most keys with others, counted with repeats; one original among many copies of it
    is in the largest keys, so that most copies are linked by pairs with it.
    """
    sized = shared.join(shared.groupBy("key").agg(F.count("*").alias("n")), "key")
    degrees = sized.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = shared.join(degrees, "node").groupBy("key").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"))
    return shared.join(hubs, "key").filter("node <> hub").select("hub", "node").distinct()


#: Nodes of a key that are compared with each other at once; a key with more of them is cut into blocks, whose pairs go to several tasks.
KEY_BLOCK = 256


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many members each set of `left` has in common with each of `right`: products of 0-1 matrices, some columns at a time."""
    both = [*left, *right]
    sizes = [len(x) for x in both]
    values, place, seen = np.unique(np.concatenate([*both, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(both)), sizes)
    keep = seen[place] > 1  # a member of one set alone is in no common part
    owner, place = owner[keep], np.unique(place[keep], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, b = np.searchsorted(place, [at, at + columns])
        x = np.zeros((len(both), columns), np.float32)
        x[owner[a:b], place[a:b] - at] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out.astype(np.int64)


def _forest(pairs: np.ndarray, roots: np.ndarray) -> list[tuple[int, int]]:
    """Of the (x, y) index pairs, the (root, root) links that join what they all join."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = parent[x]
        return x

    out = []
    for x, y in pairs.tolist():
        p, q = top(int(roots[x])), top(int(roots[y]))
        if p != q:
            parent[p] = q
            out.append((p, q))
    return out


def key_links(mixed: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links between the roots of (key, node, root) rows which join all that pairs of nodes with one key and at least that similarity join.

    A key's nodes meet in one stream, in blocks that are compared pair by pair of blocks; pairs are counted there and only
    as many links leave as join the block's roots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, sides, sets = None, [], [], []

        def links() -> list[tuple[int, int]]:
            if len(set(rows)) < 2:
                return []
            side, root, size = np.array(sides), np.array(rows), np.array([len(x) for x in sets])
            alone = now[1] == now[2]
            p, q = (np.arange(len(root)),) * 2 if alone else (np.flatnonzero(side == now[1]), np.flatnonzero(side == now[2]))
            both = shared_counts([sets[k] for k in p], [sets[k] for k in q])
            near = (both >= similarity * (size[p][:, None] + size[q][None, :] - both) - 1e-9) & (root[p][:, None] != root[q][None, :])
            x, y = np.nonzero(near)
            return _forest(np.stack([p[x], q[y]], axis=1), root)

        found: list[tuple[int, int]] = []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            root, side = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            texts = batch.column(5).to_pylist()
            for a, b in slices(texts, 512, 2_000_000):
                for k, own in zip(range(a, b), shingle_sets(texts[a:b], words)):
                    if keys[k] != now:
                        found += links() if now else []
                        now, rows, sides, sets = keys[k], [], [], []
                    rows.append(root[k])
                    sides.append(side[k])
                    sets.append(own)
        found += links() if now else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    blocks = F.ceil(F.col("n") / KEY_BLOCK).cast("int")
    sized = mixed.join(mixed.groupBy("key").agg(F.count("*").alias("n")), "key")
    own = sized.withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = own.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "root", "side", "node")
    moved = dealt.join(texts, "node").select("key", "i", "j", "root", "side", "text")
    return moved.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def copy_roots(shared: DataFrame, texts: DataFrame, words: int, similarity: float, links: DataFrame | None = None) -> DataFrame:
    """(node, root) of all nodes which pairs of (key, node) rows with at least that similarity join, or such (hub, node) rows of `links`.

    Those links and pairs with each key's hub come first; keys that hold one part alone afterwards are done, and the nodes of the others are
    compared with each other, by key.
    """
    pairs = hub_pairs(shared)
    pairs = checkpoint(pairs if links is None else links.union(pairs).distinct())
    parts = checkpoint(connected_components(checkpoint(verified(pairs, texts, words, similarity))))
    rooted = shared.join(parts, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    rooted = checkpoint(rooted.join(mixed, "key", "left_semi"))
    # components of the roots found so far
    more = checkpoint(connected_components(checkpoint(key_links(rooted, texts, words, similarity)))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = parts.join(more, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = more.join(parts.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return checkpoint(moved.unionByName(alone))


def fingerprint_links(marked: DataFrame, sets: DataFrame, text_col: str, words: int) -> DataFrame:
    """(hub, node): in each SimHash group (see `simhash_dedup`) the node of every other shingle set with that of the first; still to be verified."""
    spark, before = marked.sparkSession, scratch_mark()
    groups = near_duplicate_groups(marked.select("num", F.col(f"row.`{text_col}`").alias("text")), "num", "text", words)
    member = groups.select(F.col("id").alias("num"), F.col("component_id").alias("group"))
    held = member.join(marked.select("num", "high", "low"), "num").select("high", "low", "group").distinct()
    held = checkpoint(held.join(sets.select("high", "low", "node"), ["high", "low"]).select("group", "node"))
    clear_scratch(spark, before, scratch_mark())
    first = held.groupBy("group").agg(F.min("node").alias("hub"))
    return held.join(first, "group").filter("node <> hub").select("hub", "node").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, fingerprint_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their bands, stored; (high, low, n, component_id, first) of each shingle set): n rows have the set, first is the row that stands for the group."""
    if not 0.8 <= similarity <= 1:
        raise ValueError("similarity must be from 0.8 to 1")
    spark = docs.sparkSession
    with small_batches(spark):
        marked = materialise(add_bands(docs, id_col, text_col, words), "bands")
    # one row stands for each set, whose number is the node
    order = F.struct(F.col("id").isNull().alias("none"), "id", "num")
    sets = marked.groupBy("high", "low").agg(F.min("num").alias("node"), F.count("*").alias("n"), F.min("id").alias("least"), F.min(order).alias("best"))
    sets = materialise(sets, "copy-sets")
    links = checkpoint(fingerprint_links(marked, sets, text_col, fingerprint_words)) if fingerprint_words else None
    nodes = sets.select(F.col("node").alias("num"))
    keyed = materialise(marked.select("num", "keys").join(nodes, "num", "left_semi").select(F.col("num").alias("node"), F.explode("keys").alias("key")), "band-keys")
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    shared = materialise(keyed.join(many, "key", "left_semi"), "shared-keys")
    texts = marked.select(F.col("num").alias("node"), whole_text(F.col(f"row.`{text_col}`")).alias("text"))
    compared = shared.select("node") if links is None else shared.select("node").union(links.select("hub")).union(links.select("node"))
    texts = materialise(texts.join(compared.distinct(), "node", "left_semi"), "band-texts")
    with small_batches(spark):
        roots = copy_roots(shared, texts, words, similarity, links)
    rooted = checkpoint(sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("best").alias("best"))
    groups = rooted.select("high", "low", "root", "n").join(named, "root")
    return marked, materialise(groups.select("high", "low", "n", "component_id", F.col("best.num").alias("first")), "copy-groups")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of `docs`: id, component_id.

    component_id is the smallest id reachable over pairs whose sets of `words`-word shingles have at least the
    Jaccard `similarity` (0.8 or more, as the bands are made for it).  Null text counts as empty; texts without words are
    copies of each other.  Rows with a null id are linked too but never name a group.
    """
    with shuffles_removed(docs.sparkSession):
        marked, groups = _grouped(docs, id_col, text_col, words, similarity)
    return join_hot(marked.select("id", "high", "low"), groups.select("high", "low", "n", "component_id"), ["high", "low"], "n").select("id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, fingerprint_words: int | None = None) -> DataFrame:
    """One row of each group of near copies (see near_copy_groups), with the columns of `docs`: the one with the smallest id.

    With fingerprint_words, texts whose SimHash fingerprints over shingles of so many words are linked by the Golay keys of `simhash_dedup`
    (at most four bits) are compared first, and the bands then give the copies with more bits between them.

    Decided by row, not by id: rows that share an id but not a group stay, exact repeats of a row do not.  A row with a null id
    stays only if its group has no row with an id.  An empty table gives an empty one.
    """
    with shuffles_removed(docs.sparkSession):
        marked, groups = _grouped(docs, id_col, text_col, words, similarity, fingerprint_words)
    own = join_hot(marked.select("num", "high", "low"), groups.select("high", "low", "n", "first"), ["high", "low"], "n")
    extra = own.filter("num <> first").select("num")
    return marked.join(extra, "num", "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
