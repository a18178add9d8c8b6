"""Plans on histograms of every kind: all pieces used, few left to best fit, few sequences above what any plan needs."""

import numpy as np
import pytest

from loomfield.llm import packing

C = packing.CAPACITY


def counted(lengths):
    return np.bincount(np.clip(np.asarray(lengths).astype(int), 1, C), minlength=C + 1)


def third():
    x = np.random.default_rng(6).lognormal(np.log(300), 1.0, 300_000)
    x[:100_000] = 777
    return counted(x)


#: name, histogram, share of sequences above the bound that is allowed (None: the bound cannot be met)
CASES = [
    ("even", np.concatenate(([0], np.full(C, 2441))), 0.001), ("random", counted(np.random.default_rng(0).integers(1, C + 1, 2_000_000)), 0.001), ("about 1500", counted(np.random.default_rng(1).normal(1500, 100, 500_000)), 0.001),
    ("short", counted(np.random.default_rng(2).lognormal(np.log(20), 0.7, 500_000)), 0.001), ("middle", counted(np.random.default_rng(3).lognormal(np.log(500), 0.8, 500_000)), 0.001), ("one length", counted(np.full(100_000, 700)), None),
    ("a third alike", third(), None), ("whole", counted(np.full(50, C)), 0.0), ("tiny", counted([1]), 0.0), ("ones", counted(np.ones(5000)), 0.0),
]


@pytest.mark.parametrize(("name", "counts", "above"), CASES, ids=[c[0] for c in CASES])
def test_plans(name, counts, above):
    fitted, left = packing._fitted(counts)
    plan = packing.plan_packing(counts)
    for p in (fitted, plan):
        used = np.zeros(C + 1, np.int64)
        for pattern, n in p:
            assert sum(pattern) <= C and n > 0
            for x in pattern:
                used[x] += n
        assert (used == counts).all()
    # or less than fills two sequences
    assert left <= 0.05 * counts[:C].sum() or counts @ np.arange(C + 1) <= 2 * C or left * max(1, int(np.flatnonzero(counts)[0])) < C
    sequences = sum(n for _, n in plan)
    bound = max(-(-int(counts @ np.arange(C + 1)) // C), int(counts[C // 2 + 1 :].sum()))
    if above is not None:
        assert sequences <= np.ceil(bound * (1 + above))
    if name == "one length":
        assert sequences == 50_000


def test_no_pieces():
    assert packing.plan_packing(np.zeros(C + 1, np.int64)) == []


def test_fit_is_the_least_squares(monkeypatch):
    rng = np.random.default_rng(4)
    a = (rng.random((40, 12)) < 0.3) * rng.integers(1, 4, (40, 12))
    a[rng.integers(0, 40, 12), np.arange(12)] = 1
    want = np.maximum(rng.normal(50, 60, 12), 0)
    index, column = np.nonzero(a)
    got = packing.nnls(index, column, a[index, column].astype(float), a @ want, 12, rounds=40)
    assert (got >= 0).all() and np.abs(a @ got - a @ want).max() < 0.05
