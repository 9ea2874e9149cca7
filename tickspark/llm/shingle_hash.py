"""SimHash fingerprints of word shingles, hashed with XXH64 for a whole batch of texts at a time."""

from __future__ import annotations

import numpy as np

#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the slices data[begin:end] (bytes), one value each."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes8 = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    lanes4 = np.ndarray((len(data) - 3,), "<u4", data.data, strides=(1,))
    seed64 = np.uint64(seed)
    size = (end - begin).astype(np.int64)
    at = begin.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        h = np.full(len(at), seed64 + P5, np.uint64)
        if len(long := np.flatnonzero(size >= 32)):
            p, left = at[long], size[long].copy()
            v = [np.full(len(long), x, np.uint64) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            live = np.arange(len(long))
            while len(live):
                for k in range(4):
                    v[k][live] = _round(v[k][live], lanes8[p[live] + 8 * k])
                p[live] += 32
                left[live] -= 32
                live = live[left[live] >= 32]
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _round(np.zeros_like(x), x)) * P1 + P4
            h[long], at[long] = acc, p
        h += size.astype(np.uint64)
        stop = end.astype(np.int64)
        while len(live := np.flatnonzero(stop - at >= 8)):
            x = h[live] ^ _round(np.zeros(len(live), np.uint64), lanes8[at[live]])
            h[live] = _rotl(x, 27) * P1 + P4
            at[live] += 8
        if len(live := np.flatnonzero(stop - at >= 4)):
            x = h[live] ^ (lanes4[at[live]].astype(np.uint64) * P1)
            h[live] = _rotl(x, 23) * P2 + P3
            at[live] += 4
        while len(live := np.flatnonzero(stop - at >= 1)):
            x = h[live] ^ (data[at[live]].astype(np.uint64) * P5)
            h[live] = _rotl(x, 11) * P1
            at[live] += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def shingle_hashes(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle, place of its text, number of shingles of each text); a text without words has none.

    A-Z are lowered, words are runs of anything but \\x20 and \\x09-\\x0D, shingles of so many
    words keep repeats and are joined by one space; a shorter text is one shingle.
    """
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    # A text after another is parted from it by a space.
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    text_end = np.cumsum([len(x) + 1 for x in raw])
    space = data == 32
    before = np.concatenate([[True], space[:-1]])
    keep = ~(space & before)
    owner_shift = np.cumsum(keep)  # bytes kept up to and including each
    data = data[keep]
    space = space[keep]
    end = np.flatnonzero(space)
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    kept_end = owner_shift[text_end - 1]
    n_words = np.diff(np.concatenate([[0], np.searchsorted(end, kept_end)]))
    last_word = np.cumsum(n_words)
    first_word = last_word - n_words
    n_shingles = np.where(n_words == 0, 0, np.maximum(n_words - words + 1, 1))
    owner = np.repeat(np.arange(len(texts)), n_shingles)
    if not len(owner):
        return np.zeros(0, np.uint64), owner, n_shingles
    base = np.cumsum(n_shingles) - n_shingles
    first = first_word[owner] + np.arange(len(owner)) - base[owner]
    last = np.minimum(first + words, last_word[owner]) - 1
    return xxh64(data, begin[first], end[last]), owner, n_shingles


def fingerprints(texts: list[str], words: int = 4) -> np.ndarray:
    """One 64-bit SimHash of the shingles for each text (a text without words has zero)."""
    if not texts:
        return np.zeros(0, np.uint64)
    h, owner, n_shingles = shingle_hashes(texts, words)
    if not len(owner):
        return np.zeros(len(texts), np.uint64)
    parts = h.view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(texts), 64))
    for at in range(0, len(texts), 256):
        lo, hi = np.searchsorted(owner, [at, min(at + 256, len(texts))])
        n = min(256, len(texts) - at)
        slot = (owner[lo:hi] - at) * 256
        for k in range(8):
            seen = np.bincount(slot + parts[lo:hi, k], minlength=n * 256).reshape(n, 256)
            counts[at : at + n, 8 * k : 8 * k + 8] = seen @ _BITS
    bits = 2 * counts > n_shingles[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
