"""Slopes and probabilities of many positions take a few positions at once and are those of each position alone."""

import tracemalloc

import numpy as np

from tramlines.llm import maxent

WHICH = (0, 1, 4)


def factor(seed, most=1 << 12):
    rng = np.random.default_rng(seed)
    f = maxent._factor(rng.random((8, 48)) * 4000, len(WHICH), most, maxent.Shape())
    maxent._scale(f, rng.poisson(0.5, f.table.shape) * rng.integers(0, 40, (len(f.table), 1)), 4.0)
    return f


def positions(n, seed=1):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, (n, 5)).astype(np.uint64), rng.integers(0, 8, n), rng.integers(0, 48, n)


def test_slopes_and_probabilities_by_position():
    f, n, smooth = factor(0), 2 * maxent.AT_ONCE + 5, 4.0
    feats, node, outcome = positions(n)
    gain = np.random.default_rng(2).uniform(-0.2, 0.8, len(WHICH) * maxent.BINS)
    rows = f.rows(feats, WHICH, node)
    got = maxent._slopes(f, WHICH, gain, feats, node, outcome, smooth)
    every, one = maxent.outcomes(f, WHICH, feats, node), maxent.outcomes(f, WHICH, feats, node, outcome)
    for at in [0, 1, maxent.AT_ONCE - 1, maxent.AT_ONCE, 2 * maxent.AT_ONCE, n - 1]:
        x, prior, o = f.table[rows[:, at]].astype(float), f.prior[node[at]].astype(float), outcome[at]
        expected = smooth * np.exp(prior[o])
        count = np.exp(x[:, o]) * (f.uses[rows[:, at]] / smooth + 1) * expected
        without = x.copy()
        without[:, o] += np.log(np.maximum(count - 1, expected) / count)
        place = np.arange(len(WHICH)) * maxent.BINS + f.bins[rows[:, at]]
        loss = lambda g, x=without, prior=prior, o=o, place=place: np.log(np.exp(prior + g[place] @ x).sum()) - (prior + g[place] @ x)[o]
        steps = np.eye(len(gain)) * 1e-5
        assert np.allclose(got[at], [(loss(gain + s) - loss(gain - s)) / 2e-5 for s in steps], atol=1e-4)
        z = prior + x.sum(0)
        assert np.allclose(every[at], z - np.log(np.exp(z).sum()), atol=1e-4) and np.isclose(one[at], every[at, o], atol=1e-5)


def test_room_does_not_grow_with_outcomes_of_all_positions():
    f, n = factor(0), 1 << 16
    feats, node, outcome = positions(n)
    tracemalloc.start()
    try:
        maxent.outcomes(f, WHICH, feats, node, outcome)
        assert tracemalloc.get_traced_memory()[1] < n * 48 * 4 / 2
    finally:
        tracemalloc.stop()


def test_no_positions():
    f, none = factor(0), np.zeros(0, np.int64)
    feats = np.zeros((0, 5), np.uint64)
    assert maxent.outcomes(f, WHICH, feats, none).shape == (0, 48) and maxent.outcomes(f, WHICH, feats, none, none).shape == (0,)
    assert maxent._slopes(f, WHICH, np.zeros(len(WHICH) * maxent.BINS), feats, none, none, 4.0).shape == (0, 24)
