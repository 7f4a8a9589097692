"""Joint choice of lengths: never dearer than the best single length, near the optimum of small cases."""

import numpy as np
import pytest

from lithic.llm.packing import CAPACITIES, best_fit, pack_bins, sequence_cost


def total(sizes, capacities, cost):
    return sum(cost(c) for c in pack_bins(np.array(sizes), capacities, cost)[1])


def optimum(sizes, capacities, cost):
    """Least cost over all partitions of the sizes into bins."""
    best = float("inf")

    def place(k, bins, least):
        nonlocal best
        if k == len(sizes):
            best = min(best, sum(cost(next(c for c in capacities if c >= b)) for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacities[-1] and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]], least)
        place(k + 1, [*bins, sizes[k]], least)

    place(0, [], 0)
    return best


@pytest.mark.parametrize("attention", [1e12, 12_288.0, 2_000.0])
def test_never_above_the_best_single_length(attention):
    rng = np.random.default_rng(4)
    cost = lambda c: sequence_cost(c, 32, attention)
    sets = [rng.integers(1, 4097, 300), np.minimum(4096, rng.lognormal(6, 1, 600).astype(int) + 1), [520] * 401, [1100] * 200 + [520] * 201, [1100] * 100 + [30] * 700, [4096, 1], [512]]
    for sizes in sets:
        sizes = np.array(sizes)
        single = []
        for c in CAPACITIES:
            if c >= sizes.max():
                _, used = best_fit(sizes, (c,), cost, lambda n: next(x for x in CAPACITIES if x >= n))
                single.append(sum(cost(next(x for x in CAPACITIES if x >= n)) for n in used))
        assert total(sizes, CAPACITIES, cost) <= min(single) + 1e-6


def test_mixed_lengths_pay():
    """Where long pieces need the long bin, short ones still go to short bins."""
    sizes = [1000] * 40 + [60] * 200
    bins, capacity, used = pack_bins(np.array(sizes), (64, 1024), lambda c: sequence_cost(c, 1, 500))
    assert set(capacity) == {64, 1024}


def test_near_the_optimum_of_small_cases():
    rng = np.random.default_rng(6)
    for _ in range(40):
        sizes = sorted(rng.integers(1, 65, rng.integers(1, 8)).tolist(), reverse=True)
        cost = lambda c: sequence_cost(c, 4, 100)
        assert optimum(sizes, (16, 32, 64), cost) <= total(sizes, (16, 32, 64), cost) + 1e-9 <= 1.2 * optimum(sizes, (16, 32, 64), cost)
