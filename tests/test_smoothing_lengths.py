"""Histories of many lengths share the passes of the smoothing family."""

import numpy as np

from tallycast.forecast import smoothing


def histories():
    rng, lengths = np.random.default_rng(5), np.array([3, 7, 9, 10, 23, 24, 25, 31, 40, 47, 48, 60, 60, 61])
    y = np.zeros((len(lengths), 60 + 1))
    for r, n in enumerate(lengths):
        y[r, :n] = rng.integers(1, 40, n) if r % 2 else (rng.random(n) < 0.4) * rng.integers(1, 40, n)
    return y, lengths


def paths(y, lengths):
    out = np.zeros((len(y), 6))
    for rows, t, path in smoothing.smoothing_family(y, lambda t: np.flatnonzero(lengths == t), 6):
        assert (lengths[rows] == t).all()
        out[rows] = path
    return out


def test_together_as_alone():
    y, lengths = histories()
    alone = [paths(y[r : r + 1, :n], lengths[r : r + 1])[0] for r, n in enumerate(lengths)]
    np.testing.assert_allclose(paths(y, lengths), alone, rtol=1e-9, atol=1e-9)


def test_passes_do_not_grow_with_the_number_of_lengths(monkeypatch):
    y, lengths = histories()
    calls, passes = [], smoothing.passes
    monkeypatch.setattr(smoothing, "passes", lambda *a: calls.append(0) or passes(*a))
    long = lengths >= 24
    paths(y[long], lengths[long])
    many = len(calls)
    paths(y[-1:], lengths[-1:])
    assert many <= 2 * (len(calls) - many)
