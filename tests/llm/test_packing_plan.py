"""The linear program is solved to its dual, serves every length, and its configurations make the plan."""

import json
from collections import Counter
from functools import cache

import numpy as np
import pytest

from timbrewell.llm import packing


def test_every_length_is_served():
    rng = np.random.default_rng(7)
    lengths = np.arange(1, 200)
    counts = rng.integers(1, 50, len(lengths))
    served = np.zeros(len(lengths))
    solved, bound = packing.fractional(lengths, counts, 256)
    for held, amount in solved:
        assert sum(int(lengths[i]) * t for i, t in held.items()) <= 256
        for i, t in held.items():
            served[i] += t * amount
    assert (served >= counts * (1 - 1e-6)).all()
    assert (lengths * counts).sum() / 256 <= bound + 1e-9 <= sum(v for _, v in solved) * (1 + 1e-9) + 1e-9


def many(seed, n=12_000):
    """Lengths like those of texts: many short ones, a long tail."""
    return Counter(int(x) for x in np.clip(np.random.default_rng(seed).lognormal(6, 1, n), 1, 2047))


@pytest.mark.parametrize("seed", [1, 2])
def test_the_program_is_solved_and_makes_the_plan(seed, monkeypatch):
    given, plain = [], packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda lengths, counts, capacity: given.append(int(counts.sum())) or plain(lengths, counts, capacity))
    histogram = many(seed)
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[int(x)] for x in lengths])
    solved, bound = packing.fractional(lengths, counts, 2048)
    assert bound <= sum(v for _, v in solved) * (1 + 1e-9) <= bound * (1 + 2 * packing.GAP)
    total = sum(n for _, n in packing.plan(histogram))
    assert len(given) == 1 and given[0] <= 0.05 * counts.sum()
    assert total <= bound * 1.002 + 2


def fewest(sizes, capacity):
    """By brute force: the least number of sequences."""

    @cache
    def need(left):
        if not left:
            return 0
        best = len(left)

        def choose(k, held, room):  # the largest piece with any others that fit
            nonlocal best
            best = min(best, 1 + need(tuple(x for i, x in enumerate(left) if i not in held)))
            for j in range(k, len(left)):
                if left[j] <= room:
                    choose(j + 1, held | {j}, room - left[j])

        choose(1, {0}, capacity - left[0])
        return best

    return need(tuple(sorted(sizes, reverse=True)))


def test_small_histograms_against_the_optimum():
    rng, over = np.random.default_rng(11), 0
    for _ in range(60):
        sizes = rng.integers(1, 20, rng.integers(1, 9)).tolist()
        best, got = fewest(sizes, 20), sum(n for _, n in packing.plan(dict(Counter(sizes)), 20))
        assert best <= got <= best + 1, json.dumps(sizes)
        over += got > best
    assert over <= 6
