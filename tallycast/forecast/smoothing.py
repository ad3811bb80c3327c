"""Exponential smoothing as one family: trend or none, season or none, absolute or relative errors, chosen by AICc.

The gains of every form are refined from the best point of a grid by a pattern search: all series of a batch and all
trial points run at once, and only time is a loop. A trial replaces the point only if its likelihood is better, so a
form never ends below its grid. The work of a series is proportional to its length.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
from pyspark import cloudpickle

from tallycast.forecast.state import SEASON

TINY = 1e-9
#: Gains: of the level, share of it for the slope, damping, of the season.
LOW, HIGH = np.array([0.01, 0.01, 0.8, 0.0]), np.array([0.99, 1.0, 1.0, 1.0])
STEP, ROUNDS = np.array([0.1, 0.1, 0.05, 0.1]), 14
FIRST_VALUES = 10  # of the line that gives the first level and slope
ROWS, TOGETHER = 512, 20  # series and points of a grid in one pass, keeps its arrays in cache
#: (trend, season, relative errors)
FORMS = tuple(product((False, True), repeat=3))
_POINTS = {
    False: np.array([(a, 0.01, 0.9, 0.0) for a in (0.05, 0.1, 0.2, 0.3, 0.5)]),
    True: np.array([(a, b, d, 0.0) for a, b, d in product((0.05, 0.1, 0.2, 0.3, 0.5), (0.02, 0.1, 0.3), (0.8, 0.9, 0.95, 0.98))]),
}

State = tuple[np.ndarray, np.ndarray, np.ndarray]  # level, slope (rows, points) and season (rows, SEASON, points)


def grid(trend: bool, season: bool) -> np.ndarray:
    """Starting points of a form (points, 4)."""
    points = _POINTS[trend]
    if not season:
        return points
    return np.concatenate([points + [0, 0, 0, g] for g in (0.05, 0.2)])


def size(trend: bool, season: bool) -> int:
    """Parameters of a form: gains, first states and the variance."""
    return 3 + 3 * trend + (SEASON + 1) * season


def first_state(y: np.ndarray, trend: bool, season: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, slope and season before the first step: from two seasons, or from a line through the first ten values."""
    months = np.zeros((len(y), SEASON))
    if season:
        one, two = y[:, :SEASON], y[:, SEASON : 2 * SEASON]
        months = (one + two - one.mean(1, keepdims=True) - two.mean(1, keepdims=True)) / 2
        level, slope = one.mean(1), (two.mean(1) - one.mean(1)) / SEASON
    else:
        head = y[:, :FIRST_VALUES]
        x = np.arange(head.shape[1]) - (head.shape[1] - 1) / 2
        slope = head @ x / max(float(x @ x), 1.0)
        level = head.mean(1) + slope * (x[0] - 1) * trend
    return level, slope * trend, months


def passes(
    y: np.ndarray, points: np.ndarray, trend: bool, season: bool, relative: bool, lengths: np.ndarray | None = None
) -> tuple[np.ndarray, State]:
    """Twice the negative log-likelihood (rows, points), without its constant, and the last state, for gains (rows, points, 4).

    With relative errors it is infinite where a value or a forecast is not above zero. Rows of several lengths go
    together: the longest come first, and a step works on those that reach it. Arrays lie by point, so that a step is a
    few operations on long runs of memory, and steps that a form does not have are left out.
    """
    rows, count = points.shape[:2]
    lengths = np.full(rows, y.shape[1]) if lengths is None else lengths
    order = np.argsort(-lengths, kind="stable")
    alive = rows - np.searchsorted(np.sort(lengths), np.arange(y.shape[1]), side="right")
    alpha, share, phi, gamma = (np.ascontiguousarray(points[order, :, k].T) for k in range(4))
    beta, renewal = alpha * share, gamma * (1 - alpha)
    first, values = first_state(y[order], trend, season), np.ascontiguousarray(y[order].T)
    level, slope = (np.repeat(a[None], count, axis=0) for a in first[:2])
    months = np.repeat(first[2].T[:, None], count, axis=1)
    error, scale, bad = np.zeros_like(level), np.zeros_like(level), np.zeros(level.shape, bool)
    scratch = [np.empty_like(level) for _ in range(4)]
    k = None
    for t in range(int(lengths.max(initial=0))):
        if k != alive[t]:
            k = alive[t]
            a, b, f, g, lev, slo, err, log, out, drift, base, ahead, miss = (
                x[:, :k] for x in (alpha, beta, phi, renewal, level, slope, error, scale, bad, *scratch)
            )
        value, month = values[t, :k], months[t % SEASON, :, :k]
        if trend:
            np.multiply(f, slo, out=drift)
            np.add(lev, drift, out=base)
        else:
            np.copyto(base, lev)
        np.subtract(value, np.add(base, month, out=ahead) if season else base, out=miss)
        if relative:
            due = ahead if season else base
            out |= (due <= TINY) | (value <= 0)
            safe = np.maximum(due, TINY)
            err += (miss / safe) ** 2
            log += np.log(safe)
        else:
            np.multiply(miss, miss, out=ahead)
            err += ahead
        np.multiply(a, miss, out=ahead)
        np.add(base, ahead, out=lev)
        if trend:
            np.multiply(b, miss, out=ahead)
            np.add(drift, ahead, out=slo)
        if season:
            np.multiply(g, miss, out=ahead)
            month += ahead
    n = np.maximum(lengths[order], 1)
    score = n * np.log(np.maximum(error, TINY) / n) + 2 * scale
    score[bad | ~np.isfinite(score)] = np.inf
    back = np.empty(rows, dtype=np.int64)
    back[order] = np.arange(rows)
    return score.T[back], (level.T[back], slope.T[back], months.transpose(2, 0, 1)[back])


def refined(
    y: np.ndarray, trend: bool, season: bool, relative: bool, lengths: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Best gains of each row (rows, 4) and their score: pattern search from the best point of the grid."""
    points = grid(trend, season)
    tried = [
        passes(y, np.repeat(points[None, lo : lo + TOGETHER], len(y), axis=0), trend, season, relative, lengths)[0]
        for lo in range(0, len(points), TOGETHER)
    ]
    score = np.concatenate(tried, axis=1)
    rows, pick = np.arange(len(y)), np.argmin(score, axis=1)
    best, score = points[pick], score[np.arange(len(y)), pick]
    free = [0] + [1, 2] * trend + [3] * season
    moves = np.concatenate([sign * STEP[k] * np.eye(4)[[k]] for k in free for sign in (1, -1)])
    reach = np.ones(len(y))
    for _ in range(ROUNDS):
        trial = np.clip(best[:, None] + reach[:, None, None] * moves[None], LOW, HIGH)
        found, _ = passes(y, trial, trend, season, relative, lengths)
        pick = np.argmin(found, axis=1)
        better = found[rows, pick] < score
        best = np.where(better[:, None], trial[rows, pick], best)
        score = np.where(better, found[rows, pick], score)
        reach = np.where(better, reach, reach / 2)
    return best, score


def search(y: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """AICc (rows, forms), gains (rows, forms, 4) and the form of least AICc; forms too large for the length are infinite.

    Rows may be shorter than ``y`` (``lengths``) if all have ten values.
    """
    n = np.full(len(y), y.shape[1]) if lengths is None else lengths
    aicc, gains = np.full((len(y), len(FORMS)), np.inf), np.zeros((len(y), len(FORMS), 4))
    above = ((y > 0) | (np.arange(y.shape[1]) >= n[:, None])).all(axis=1)
    for f, (trend, season, relative) in enumerate(FORMS):
        k = size(trend, season)
        able = np.flatnonzero((above | (not relative)) & (n >= 2 * SEASON * season) & (n > k + 1))
        if not len(able):
            continue
        gains[able, f], score = refined(y[able], trend, season, relative, n[able])
        aicc[able, f] = score + 2 * k + 2 * k * (k + 1) / (n[able] - k - 1)
    return aicc, gains, np.argmin(aicc, axis=1)


def _paths(own: np.ndarray, n: np.ndarray, horizon: int) -> np.ndarray:
    """Forecasts of each row's best form, fitted to its first n values; below ten values all rows have the same n."""
    aicc, gains, form = search(own, n)
    path = np.zeros((len(own), horizon))
    told = np.isfinite(aicc.min(axis=1))
    path[~told] = own[~told].sum(axis=1, keepdims=True) / np.maximum(n[~told], 1)[:, None]
    for f, (trend, season, relative) in enumerate(FORMS):
        at = np.flatnonzero(told & (form == f))
        if len(at):
            point = gains[at, f][:, None]
            _, (level, slope, months) = passes(own[at], point, trend, season, relative, n[at])
            powers = point[:, :, 2] ** np.arange(1, horizon + 1)
            phase = (n[at, None] + np.arange(horizon)) % SEASON
            path[at] = level + slope * np.cumsum(powers, axis=1) + months[np.arange(len(at))[:, None], phase, 0]
    return path


def smoothing_family(y: np.ndarray, due: Callable[[int], np.ndarray], horizon: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Forecasts of each row's best form, fitted to its first t values. Up to four values no form can be told: the mean."""
    wanted = [(t, rows) for t in range(y.shape[1] + 1) if len(rows := due(t))]
    if not wanted:
        return
    rows = np.concatenate([found for _, found in wanted])
    n = np.repeat([t for t, _ in wanted], [len(found) for _, found in wanted])
    path = np.empty((len(rows), horizon))
    # The line through the first ten values needs them, so shorter histories go by their own length.
    short = np.searchsorted(n, np.arange(FIRST_VALUES + 1))
    cuts = np.unique([*short, *range(short[-1], len(n), ROWS), len(n)])
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        size_ = n[lo:hi]
        own = np.where(np.arange(size_.max()) < size_[:, None], y[rows[lo:hi], : size_.max()], 0.0)
        path[lo:hi] = _paths(own, size_, horizon)
    low = 0
    for t, found in wanted:
        yield found, t, path[low : low + len(found)]
        low += len(found)


# The functions travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
