"""F8: the search of many bins ends where no step helps between any two of them, not only within one half."""

from collections import Counter

import numpy as np

from tickspark.llm import packing as P


def steps_left(bins, size):
    """Pairs of underfull bins' patterns, the emptier one first, between which a step helps."""
    under = sorted((sum(p), p, n) for p, n in bins.items() if n and sum(p) < size)
    return [(d, t) for k, (_, d, n) in enumerate(under) for f, t, _ in under[k:] if (d != t or n > 1) and P._exchange(t, d, size - f)]


def test_no_step_is_left_between_halves():
    counts = dict(Counter(np.random.default_rng(3).integers(200, 701, 40_000).tolist()))
    first = P.best_fit(counts, 1024)
    assert sum(n for p, n in first.items() if sum(p) < 1024) > 2 * P.SEARCHED
    better = P.local_search(first, 1024)
    least = -(-sum(k * n for k, n in counts.items()) // 1024)
    assert sum(better.values()) < sum(first.values())
    assert sum(better.values()) == least or not steps_left(better, 1024)
    placed = Counter()
    for pattern, times in better.items():
        for length in pattern:
            placed[length] += times
    assert placed == counts


def test_the_best_step_is_that_of_all_sums():
    rng = np.random.default_rng(5)
    for _ in range(2000):
        target, donor = (tuple(sorted(rng.integers(1, 40, rng.integers(1, 6)).tolist(), reverse=True)) for _ in range(2))
        room = int(rng.integers(1, 30))
        pick = lambda p, n: {0} if n == 0 else {p[i] + (p[j] if n == 2 else 0) for i in range(len(p)) for j in range(len(p)) if n == 1 or i < j}
        gains = [g - t for n, m in ((1, 0), (1, 1), (2, 1), (1, 2)) for g in pick(donor, n) for t in pick(target, m) if 0 < g - t <= room]
        found = P._exchange(target, donor, room)
        assert (max(gains) if gains else None) == (sum(found[0]) - sum(target) if found else None)
        assert not found or sorted(found[0] + found[1]) == sorted(target + donor)
