"""The estimate loses no more pairs at the threshold than is stated."""

import math

import pytest

from lithic.llm import near_dedup as N


@pytest.mark.parametrize(("threshold", "stated"), [(0.85, 1e-9), (0.8, 5e-8)])
def test_summed_chance_of_a_miss(threshold, stated):
    chance = 2.0**-N.BITS
    enough = threshold - N.MARGIN * math.sqrt(threshold * (1 - threshold) / N.HASHES * 16 / 15)
    lanes = math.ceil(N.HASHES * (enough * (1 - chance) + chance))
    p = threshold + (1 - threshold) * chance
    below = sum(math.comb(N.HASHES, k) * p**k * (1 - p) ** (N.HASHES - k) for k in range(lanes))
    assert below + (1 - threshold**N.ROWS) ** N.BANDS < stated
