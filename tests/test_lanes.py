"""Small trees that share a mask add the same numbers as trees on their own."""

import numpy as np

from raresift.operators import trees


def _random_tree(rng, splits, features=5, bins=16):
    t = trees.Tree()
    for _ in range(splits):
        node = rng.choice([n for n, f in enumerate(t.feature) if f < 0])
        t.split(int(node), int(rng.integers(features)), int(rng.integers(bins - 1)), (1.0, 1.0, 1.0), (1.0, 1.0, 1.0))
    t.value = rng.normal(size=len(t.feature)).tolist()
    return t


def test_lanes_add_what_trees_add():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 16, (5, 700)).astype(np.uint8)
    pending = [([0, 2], [_random_tree(rng, int(rng.integers(0, 8))), _random_tree(rng, 7)]) for _ in range(11)]
    alone = [(np.array(p), trees.Packed.of(some, 16)) for p, some in pending]
    together = trees._rounds(pending, 16)
    assert len(together) == 3 and all(isinstance(r, trees.Lanes) for r in together)
    none = np.zeros((0, 700))
    found = trees._margins(([0, 1, 2], [0.5, 0.0, -1.0], together), none, x)
    assert (found == trees._margins(([0, 1, 2], [0.5, 0.0, -1.0], alone), none, x)).all()
    assert (found[1] == 0).all()


def test_larger_trees_stay_alone():
    rng = np.random.default_rng(6)
    pending = [([0], [_random_tree(rng, 3)]), ([0], [_random_tree(rng, 9)])]
    assert not any(isinstance(r, trees.Lanes) for r in trees._rounds(pending, 16)) and trees._rounds([], 16) == []


def test_sums_without_rows_that_add_nothing():
    rng = np.random.default_rng(8)
    cell, rare = rng.integers(0, 20, 1000), np.where(rng.random(1000) < 0.01, rng.random(1000), 0.0)
    values = [np.where(rare > 0, 0.0, 1.7), rare, np.ones(1000)]
    found = trees._summed("forest", values)
    assert len(found[1][1]) < 50 and found[2] == (None, None)  # few rows for the rare class, none to weigh for the count
    for (some, v), want in zip(found, values):
        assert (np.bincount(cell if some is None else cell[some], v, 20) == np.bincount(cell, want, 20)).all()
    assert [s is None for s, _ in trees._summed("logistic", values)] == [True] * 3 and trees._summed("stumps", values)[2][1] is values[2]
