"""Packings of small instances against the best there is."""

from __future__ import annotations

import random
from functools import lru_cache

from docsieve.llm import packing


def optimum(items, capacity):
    items = tuple(sorted(items, reverse=True))

    @lru_cache(maxsize=None)
    def least(left, room):
        """Sequences to open for what is left, with ``room`` in the open one."""
        if not left:
            return 0
        best = 1 + least(left[1:], capacity - left[0])
        seen = set()
        for i, x in enumerate(left):
            if x <= room and x not in seen:
                seen.add(x)
                best = min(best, least(left[:i] + left[i + 1 :], room - x))
        return best

    return least(items, 0)


def test_small_instances_are_packed_nearly_always_as_well_as_can_be():
    off = 0
    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.choice([10, 20, 37])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        n = packing.solve({k: items.count(k) for k in items}, capacity)[1]
        best = optimum(items, capacity)
        assert best <= n <= best + 1
        off += n > best
    assert off <= 5


def test_what_the_reduction_fixes_costs_nothing(monkeypatch):
    """Instances whose long items each have a partner are settled by the reduction alone, and at the optimum."""
    for seed in range(60):
        rng = random.Random(seed)
        items = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randint(11, 19)
            items += [a, 20 - a]
        assert packing.solve({k: items.count(k) for k in items}, 20)[1] == optimum(items, 20) == len(items) // 2
