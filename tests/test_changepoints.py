import datetime as dt
import math

import handmade
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.config import EngineConfig
from tallycast.forecast import backtest, changepoints, closed_form, combine
from tallycast.forecast.state import series_state
from tallycast.operators import series

CFG = EngineConfig(min_periods=1, change_points=True)


def frame(spark, data):
    """Sparse rows; the first and the last step are always present."""
    rows = [
        (name, dt.date(2015 + t // 12, t % 12 + 1, 1), float(x))
        for name, values in data.items()
        for t, x in enumerate(values)
        if x != 0 or t in (0, len(values) - 1)
    ]
    return series.index_series(spark.createDataFrame(rows, "series_key string, period_start date, value double"), "M")


def brute(v, horizon):
    """Stacked least squares: a row for each step, and a row for each penalised coefficient."""
    n = len(v)
    if n < 3:
        return np.full(horizon, max(np.mean(v), 0.0))
    first, last = np.mean(v[:12]), np.mean(v[-12:])
    change = (last - first) / (first + 1)

    def row(t):
        x = t / (n - 1)
        trend = [] if change < -0.3 else [x] + [max(x - 0.8 * j / 6, 0) for j in range(1, 7)]
        season = [f(2 * math.pi * k * t / 12) for k in (1, 2, 3) for f in (math.cos, math.sin)] if n >= 24 else []
        return [1.0, *trend, *season]

    x = np.array([row(t) for t in range(n)])
    free = 0.1 if change > 0.5 else 0.05
    weights = [0.0] + ([] if change < -0.3 else [0.0] + [0.05 / free] * 6) + ([0.05 / 15] * 6 if n >= 24 else [])
    stacked = np.vstack([x, np.diag(weights)])
    b = np.linalg.lstsq(stacked, np.concatenate([v, np.zeros(len(weights))]), rcond=None)[0]
    return np.maximum([np.dot(row(n - 1 + h), b) for h in range(1, horizon + 1)], 0.0)


def bent(seed, n=72):
    """Demand that grows up to the middle of the history and is level from there, with a season."""
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return list(np.maximum(40 + 3 * np.minimum(t, n // 2) + 15 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 4, n), 0))


def test_matches_stacked_least_squares(spark):
    data = {**handmade.SERIES, "bent": bent(1), "one": [3.0], "two": [3.0, 0.0], "three": [1.0, 2.0, 5.0], "falls": list(range(60, 0, -1))}
    rows = closed_form.forecast(series_state(frame(spark, data), horizon=15, cfg=CFG), "prophet", CFG).collect()
    got = {(r.series_key, r.h): r.yhat for r in rows}
    assert len(got) == 15 * len(data)
    for name, v in data.items():
        np.testing.assert_allclose([got[name, h] for h in range(1, 16)], brute(np.array(v, float), 15), rtol=1e-6, atol=1e-6, err_msg=name)


def test_branches_and_segments(spark):
    data = {"up": bent(2), "down": [90.0 - k for k in range(60)], "level": [50.0 + k % 3 for k in range(48)]}
    rows = changepoints.trend_segments(series_state(frame(spark, data), cfg=CFG)).collect()
    by = {(r.series_key, r.segment): r for r in rows}
    assert len(rows) == 3 * 7
    assert {k: by[k, 0].branch for k in data} == {"up": "changing", "down": "flat", "level": "linear"}
    assert by["up", 0].slope > 2.5 and by["up", 6].slope < by["up", 0].slope / 2  # the ridge shrinks the bend
    assert all(by["down", j].slope == 0 for j in range(7))
    assert all(abs(by["level", j].slope) < 0.1 for j in range(7))
    assert by["up", 0].from_step == 0 and by["up", 6].from_step == pytest.approx(0.8 * 71)


def test_scale_of_a_series_does_not_matter(spark):
    v = bent(3)
    state = series_state(frame(spark, {"a": v, "b": [1000 * x for x in v]}), cfg=CFG)
    rows = {(r.series_key, r.h): r.yhat for r in closed_form.forecast(state, "prophet", CFG).collect()}
    for h in range(1, 13):
        assert rows["b", h] == pytest.approx(1000 * rows["a", h], rel=1e-9)


def test_better_than_one_line_where_trends_bend(spark):
    state = series_state(frame(spark, {f"s{k}": bent(k) for k in range(30)}), "holdout", cfg=CFG)
    scores = {}
    for bends in (False, True):
        wide = combine.closed_methods(state, EngineConfig(min_periods=1, change_points=bends))
        scores[bends] = backtest.backtest_metrics(wide, ("prophet",)).agg(F.avg("mase")).first()[0]
    assert scores[True] < 0.7 * scores[False]


def test_empty_table(spark):
    none = frame(spark, {"a": [1.0]}).where("series_key = 'b'")
    assert closed_form.forecast(series_state(none, cfg=CFG), "prophet", CFG).count() == 0
    assert changepoints.trend_segments(series_state(none, cfg=CFG)).count() == 0


def test_all_methods_take_the_slot(spark):
    state = series_state(frame(spark, {"bent": bent(4)}), cfg=CFG)
    wide = combine.all_methods(state, CFG).select("h", "prophet").collect()
    np.testing.assert_allclose([r.prophet for r in sorted(wide)], brute(np.array(bent(4)), 12), rtol=1e-6)
