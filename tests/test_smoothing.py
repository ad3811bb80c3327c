"""The smoothing family against a recursion written step by step, the grid, and random gains."""

import math

import numpy as np
import pytest

from tallycast.config import EngineConfig
from tallycast.forecast import combine, fits, smoothing
from tallycast.forecast.closed_form import levels
from tallycast.forecast.state import SEASON, series_state


def twenty():
    rng, t = np.random.default_rng(3), np.arange(48)
    out = []
    for k in range(20):
        base = 40 + k + (0.8 * t if k % 3 == 0 else 0) + (15 * np.sin(t * np.pi / 6) if k % 2 else 0)
        out.append(np.maximum(base * (1 + 0.1 * rng.normal(size=48) * (k % 4 == 0)) + 3 * rng.normal(size=48), 0.0))
    out[5][::3] = 0.0
    return np.array(out)


def plain(v, gains, trend, season, relative):
    """Score and forecast function of one series and one set of gains."""
    alpha, share, phi, gamma = gains
    if season:
        a, b = sum(v[:12]) / 12, sum(v[12:24]) / 12
        months, level, slope = [(v[i] - a + v[12 + i] - b) / 2 for i in range(12)], a, (b - a) / 12
    else:
        head, mid = v[:10], (len(v[:10]) - 1) / 2
        slope = sum((i - mid) * x for i, x in enumerate(head)) / max(sum((i - mid) ** 2 for i in range(len(head))), 1)
        months, level = [0.0] * 12, sum(head) / len(head) - (slope * (mid + 1) if trend else 0)
    slope = slope if trend else 0.0
    error = logs = 0.0
    for t, x in enumerate(v):
        ahead = level + phi * slope + months[t % 12]
        if relative and (x <= 0 or ahead <= 1e-9):
            return math.inf, None
        miss = x - ahead
        error += (miss / ahead) ** 2 if relative else miss**2
        logs += math.log(ahead) if relative else 0
        level, slope = level + phi * slope + alpha * miss, phi * slope + (alpha * share * miss if trend else 0)
        months[t % 12] += gamma * (1 - alpha) * miss if season else 0
    n = len(v)
    return n * math.log(max(error, 1e-9) / n) + 2 * logs, lambda h: level + slope * sum(phi**j for j in range(1, h + 1)) + months[(n + h - 1) % 12]


@pytest.mark.parametrize("form", smoothing.FORMS)
def test_scores_and_refinement(form):
    y, rng = twenty(), np.random.default_rng(1)
    best, score = smoothing.refined(y, *form)
    start = smoothing.grid(*form[:2])
    for v, g, s in zip(y, best, score):
        want = plain(v, g, *form)[0]
        assert (math.isinf(s) and math.isinf(want)) or s == pytest.approx(want, rel=1e-9, abs=1e-6)
        assert s <= min(plain(v, p, *form)[0] for p in start) + 1e-6
        tries = rng.uniform(smoothing.LOW, smoothing.HIGH, (60, 4))
        assert math.isinf(s) or s <= min(plain(v, p, *form)[0] for p in tries) + 2.0


def test_never_below_the_damped_trends_of_the_grid():
    y = twenty()
    _, score = smoothing.refined(y, True, False, False)
    for v, s in zip(y, score):
        assert s <= min(plain(v, (a, b, d, 0.0), True, False, False)[0] for a, b, d in fits.HOLT_GRID) + 1e-6


def test_form_is_the_least_aicc_and_suits_the_series():
    y = twenty()
    aicc, gains, form = smoothing.search(y)
    for r, v in enumerate(y):
        for f, (trend, season, relative) in enumerate(smoothing.FORMS):
            k = 1 + 1 + 1 + (3 if trend else 0) + (13 if season else 0)
            if np.isfinite(aicc[r, f]):
                assert aicc[r, f] == pytest.approx(plain(v, gains[r, f], trend, season, relative)[0] + 2 * k + 2 * k * (k + 1) / (48 - k - 1), abs=1e-5)
        assert aicc[r, form[r]] == aicc[r].min()
    seasonal = np.array([smoothing.FORMS[f][1] for f in form])
    assert seasonal[1::2].sum() >= 8 and seasonal[::2].sum() <= 2
    assert all(not smoothing.FORMS[f][2] for f in form[(y <= 0).any(axis=1)])


def test_short_flat_and_empty_histories():
    for n in range(0, 2 * SEASON):
        y = np.zeros((3, n))
        y[1], y[2] = 5.0, np.arange(n)
        (rows, t, path), = smoothing.smoothing_family(y, lambda t, n=n: np.arange(3) if t == n else np.empty(0, int), 6)
        assert t == n and path.shape == (3, 6) and np.isfinite(path).all()
        assert np.allclose(path[0], 0) and (n == 0 or np.allclose(path[1], 5))


def test_slot_in_spark(spark):
    y = twenty()
    rows = [(f"s{k:02d}", t, 48, float(x)) for k, v in enumerate(y) for t, x in enumerate(v) if x or t in (0, 47)]
    df = spark.createDataFrame(rows, "series_key string, t int, n int, value double").repartition(3, "series_key")
    state, cfg = series_state(df), EngineConfig(min_periods=1, smoothing_family=True)
    model = {r["series_key"]: r["iets"] for r in fits.fitted_at_end(levels(state, cfg), family=True).select("series_key", "fits.iets").collect()}
    slot = {(r["series_key"], r["h"]): r["iets"] for r in combine.all_methods(state, cfg).select("series_key", "h", "iets").collect()}
    _, gains, form = smoothing.search(y)
    for k, v in enumerate(y):
        ahead = plain(v, gains[k, form[k]], *smoothing.FORMS[form[k]])[1]
        for h in range(1, 13):
            want = pytest.approx(max(ahead(h), 0.0), rel=1e-6, abs=1e-6)
            assert model[f"s{k:02d}"][h - 1] == want
            # The slot draws empty periods by their share in the history.
            assert slot[f"s{k:02d}", h] == want or (min(v) == 0 and slot[f"s{k:02d}", h] == 0)
