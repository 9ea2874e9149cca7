"""The perfect (23, 12, 7) binary Golay code: table decoder and the index sets used as fuzzy keys."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial."""
    rest = np.asarray(words, np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, GENERATOR << (bit - 11), 0)
    return rest


@cache
def leaders() -> np.ndarray:
    """Error pattern of at most three bits for each of the 2048 syndromes (the code is perfect)."""
    table = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)])
        table[syndrome(patterns)] = patterns
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    words = np.asarray(words, np.int64)
    return (words ^ leaders()[syndrome(words)]) >> 11


def indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) sorted codeword indices of each word and its 23 one-bit neighbours, -1 where fewer.

    A word at distance three from its codeword has six, any other one.  Words at distance one or
    two from each other have an index in common, and the nearest index of a one-bit neighbour
    is always among them.
    """
    words = np.asarray(words, np.int64)
    around = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(23))[None, :]], axis=1)
    found = np.sort(decode(around.ravel()).reshape(around.shape), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = 1 << 20
    found = np.sort(found, axis=1)[:, :6]
    return np.where(found == 1 << 20, -1, found)
