"""Prefix scans at rolling origins and the order search with moving-average terms, against plain second opinions."""

import handmade
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.config import EngineConfig
from tallycast.forecast import backtest, combine, fits, meta, prefix
from tallycast.forecast.closed_form import levels
from tallycast.forecast.state import series_state

CFG = EngineConfig(min_periods=1)


def sparse_rows(series):
    """(series_key, t, n, value) without the empty steps, but for the first and last."""
    out = []
    for key, v in series.items():
        out += [(key, t, len(v), float(x)) for t, x in enumerate(v) if x or t in (0, len(v) - 1)]
    return out


def frame(spark, series):
    return spark.createDataFrame(sparse_rows(series), "series_key string, t int, n int, value double").repartition(3, "series_key")


def long_series():
    rng = np.random.default_rng(8)
    return {
        "weekly": list(rng.poisson(3, 400).astype(float)),
        "bursts": [float(x) if rng.random() < 0.1 else 0.0 for x in rng.integers(1, 900, 700)],
        "returns": list(rng.normal(1, 6, 150)),
        "mostly_returns": list(rng.normal(-4, 3, 60)),
        "constant": [7.0] * 300,
        "flat_then_huge": [1.0] * 260 + [1e9] * 20,
    }


def test_prefix_states_equal_the_state_of_the_shortened_series(spark):
    series = {**long_series(), "rare": handmade.SERIES["rare"], "n31": handmade.SERIES["n31"]}
    got = {(r.series_key, r.origin): r for r in prefix.prefix_states(frame(spark, series), 3).collect()}
    assert len(got) == sum(len(v) - 11 for v in series.values())
    cuts = {f"{k}|{i}": v[:i] for k, v in series.items() for i in {12, 13, 24, 30, 60, 128, 129, 255, 256, 257, len(v)} if i <= len(v)}
    want = levels(series_state(frame(spark, cuts), cfg=CFG)).collect()
    assert len(want) == len(cuts)
    for w in want:
        key, origin = w.series_key.split("|")
        r = got[key, int(origin)]
        for c in ("n", "nnz", "mean_v", "last_v", "last6", "es_level", "es_trend"):
            assert r[c] == pytest.approx(w[c], rel=1e-9, abs=1e-9), (w.series_key, c)
    for (key, origin), r in got.items():
        following = [*series[key][origin : origin + 3], None, None, None][:3]
        assert [r.next1, r.next2, r.next3] == following and r.full_n == len(series[key])


def test_dense_steps_unfold_to_the_end(spark):
    df = spark.createDataFrame([("a", 0, 5, 2.0), ("a", 2, 5, 3.0), ("b", 0, 1, 1.0)], "series_key string, t int, n int, value double")
    rows = sorted((r.series_key, r.t, r.v) for r in prefix.dense_steps(df).collect())
    assert rows == [("a", 0, 2.0), ("a", 1, 0.0), ("a", 2, 3.0), ("a", 3, 0.0), ("a", 4, 0.0), ("b", 0, 1.0)]


def test_training_rows_of_a_shorter_history_are_rows_of_the_whole(spark):
    series = {"wave": handmade.SERIES["wave"], "weekly": long_series()["weekly"][:90]}
    whole = frame(spark, series)
    cut = {k: v[: len(v) - max(3, len(v) // 5)] for k, v in series.items()}
    part = meta.before_holdout(meta.origin_rows(whole, CFG), CFG).drop("full_n")
    short = meta.rolling_origins(frame(spark, cut), CFG)
    order = ["series_key", "origin", "h"]
    a, b = part.orderBy(order).toPandas(), short.orderBy(order).toPandas()
    assert len(a) == len(b) > 0
    np.testing.assert_allclose(a[[*meta.FEATURES, "label"]], b[[*meta.FEATURES, "label"]], rtol=1e-7, atol=1e-7)


def test_training_rows_are_drawn_by_whole_origins(spark):
    rows = spark.range(3000).selectExpr("CAST(id % 100 AS STRING) AS series_key", "CAST(id / 300 AS INT) AS origin", "CAST(id % 3 AS INT) AS h")
    assert meta.drawn(rows.where("false")) is None
    assert meta.drawn(rows, EngineConfig(meta_rows=None)).count() == 3000
    some = meta.drawn(rows, EngineConfig(meta_rows=900))
    assert 500 < some.count() < 1300
    assert some.groupBy("series_key", "origin").count().select("count").distinct().count() == 1
    assert sorted(some.collect()) == sorted(meta.drawn(rows.repartition(7), EngineConfig(meta_rows=900)).collect())


def brute_arma(v, horizon):
    """The two stages with one list of observations after another, nothing kept running."""
    d = [0.0, *np.diff(v)]
    n, season = len(v), 12
    e = [0.0] * n
    lag = lambda a, t, k: a[t - k] if t >= k else 0.0
    for t in range(season + 1, n):
        past = range(season + 1, t)
        z = lambda s: np.array([lag(d, s, k) for k in (1, 2, 12, 13)])
        gram = sum((np.outer(z(s), z(s)) for s in past), np.zeros((4, 4)))
        cross = sum((z(s) * d[s] for s in past), np.zeros(4))
        ridge = np.trace(gram) / 4 / max(len(past), 1) + 1e-9
        e[t] = d[t] - np.linalg.solve(gram + ridge * np.eye(4), cross) @ z(t)
    steps = range(season + 1, n)
    best = None
    for a in ((), (1,), (12,), (1, 12), (1, 2), (1, 2, 12)):
        for b in ((), (1,), (12,), (1, 12)):
            x = np.array([[lag(d, t, k) for k in a] + [lag(e, t, k) for k in b] for t in steps]).reshape(len(steps), len(a) + len(b))
            y = np.array([d[t] for t in steps])
            gram = x.T @ x
            c = np.linalg.solve(gram + (1e-6 * np.trace(gram) / max(x.shape[1], 1) + 1e-9) * np.eye(x.shape[1]), x.T @ y)
            m, k = len(steps), x.shape[1] + 1
            if m > k + 1:
                rss = max(float(((y - x @ c) ** 2).sum()), 1e-9)
                score = m * np.log(rss / m) + 2 * k + 2 * k * (k + 1) / (m - k - 1)
                if best is None or score < best[0] - 1e-9:
                    best = (score, a, b, c)
    _, a, b, c = best
    heavy = sum(abs(x) for x in c[: len(a)])
    c = [x * min(1.0, 0.98 / heavy) if heavy > 0.98 else x for x in c[: len(a)]] + list(c[len(a) :])
    d, e, last, out = list(d), list(e), v[-1], []
    for _ in range(horizon):
        step = sum(w * d[-k] for w, k in zip(c, a)) + sum(w * e[-k] for w, k in zip(c[len(a) :], b))
        d.append(step)
        e.append(0.0)
        last += step
        out.append(last)
    return np.array(out)


def run(model, v, horizon, origins=None):
    y = np.array([v], dtype=float)
    due = lambda t: np.flatnonzero([t in (origins or (len(v),))])
    return {t: path[0] for _, t, path in fits._MODELS[model](fits._padded(y), due, horizon)}


def shocks(seed, n=84):
    """Demand that wanders slowly under much noise: its differences are a moving average."""
    rng = np.random.default_rng(seed)
    return list(np.maximum(100 + np.cumsum(rng.normal(0, 2, n)) + rng.normal(0, 12, n), 0))


@pytest.mark.parametrize("name", ["wave", "rare", "n31", "shocks"])
def test_order_search_matches_brute_force(name):
    v = shocks(1) if name == "shocks" else handmade.SERIES[name]
    np.testing.assert_allclose(run("arma", v, 15)[len(v)], brute_arma(v, 15), rtol=1e-5, atol=1e-5)


def test_order_search_at_rolling_origins_equals_refits():
    v = shocks(2)
    paths = run("arma", v, 3, origins=(24, 40, 80))
    for t, path in paths.items():
        np.testing.assert_allclose(path, brute_arma(v[:t], 3), rtol=1e-5, atol=1e-5)


def test_order_search_beats_autoregressions_on_moving_averages(spark):
    series = {f"s{k}": shocks(k) for k in range(40)}
    state = series_state(frame(spark, series), "holdout", cfg=CFG)
    scores = {}
    for ma in (False, True):
        wide = combine.all_methods(state, EngineConfig(min_periods=1, ma_terms=ma))
        metrics = backtest.backtest_metrics(wide, ("arima",))
        scores[ma] = metrics.agg(F.avg("mase")).first()[0]
    assert scores[True] < 0.97 * scores[False]
