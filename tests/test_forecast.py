import datetime as dt

import handmade
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.config import ENSEMBLE_WEIGHTS, METHODS, EngineConfig
from tallycast.forecast import backtest, closed_form, combine, fits, meta, post, profile, report
from tallycast.forecast.state import series_state
from tallycast.operators import series
from tallycast.plans import forecasting

CFG = EngineConfig(min_periods=1)


def month(k):
    return dt.date(2015 + k // 12, k % 12 + 1, 1)


def frame(spark, data, keep_zeros=False):
    """Sparse rows of the hand-made series; first and last step are always present."""
    rows = []
    for name, values in data.items():
        for t, x in enumerate(values):
            if x != 0 or keep_zeros or t in (0, len(values) - 1):
                rows.append(("item", name, month(t), float(x)))
    return spark.createDataFrame(rows, "level string, series_key string, period_start date, value double")


@pytest.fixture(scope="module")
def indexed(spark):
    return series.index_series(frame(spark, handmade.SERIES), "M").persist()


def collect_paths(df, methods):
    out = {}
    for r in df.select("series_key", "h", *methods).orderBy("series_key", "h").collect():
        for m in methods:
            out.setdefault((r.series_key, m), []).append(r[m])
    return out


CHECKED = (*closed_form.METHODS_CLOSED, "intelligent_growth")


@pytest.fixture(scope="module")
def closed_paths(indexed):
    wide = combine.closed_methods(series_state(indexed, horizon=30, cfg=CFG), CFG)
    return collect_paths(wide, (*CHECKED, "advanced_ensemble", "ensemble"))


@pytest.mark.parametrize("name", handmade.SERIES)
def test_closed_forms_match_step_by_step(closed_paths, name):
    want = handmade.opinions(handmade.SERIES[name], 30)
    for m in CHECKED:
        np.testing.assert_allclose(closed_paths[name, m], want[m], rtol=1e-7, atol=1e-7, err_msg=f"{name} {m}")
    members = {m: want[m] for m in combine.CLOSED if m in ENSEMBLE_WEIGHTS and m in want}
    ensemble = handmade.pull_to_median(members, ENSEMBLE_WEIGHTS, want["exp_smoothing"])
    np.testing.assert_allclose(closed_paths[name, "advanced_ensemble"], ensemble, rtol=1e-5, atol=1e-5)
    mean = (want["croston"] + want["sba"] + want["exp_smoothing"]) / 3
    np.testing.assert_allclose(closed_paths[name, "ensemble"], mean, rtol=1e-7, atol=1e-7)


def test_dense_rows_and_partitioning_change_nothing(spark, indexed, closed_paths):
    dense = series.index_series(frame(spark, handmade.SERIES, keep_zeros=True).repartition(7), "M")
    wide = combine.closed_methods(series_state(dense, horizon=30, cfg=CFG), CFG)
    again = collect_paths(wide, CHECKED)
    for key, path in again.items():
        np.testing.assert_allclose(path, closed_paths[key], rtol=1e-9, atol=1e-9)


def test_align_phase_moves_the_season(indexed):
    s = series_state(indexed.where("series_key = 'seasonal'"), cfg=CFG)
    s30 = series_state(indexed.where("series_key = 'small_negatives'"), cfg=CFG)
    for state, shift in ((s, 0), (s30, 7)):
        plain = [r.yhat for r in closed_form.forecast(state, "sba").orderBy("h").collect()]
        aligned = [r.yhat for r in closed_form.forecast(state, "sba", EngineConfig(align_phase=True)).orderBy("h").collect()]
        assert aligned == pytest.approx(plain[shift:] + plain[:shift])


def test_profiles(indexed):
    demand = {r.series_key: r for r in profile.demand_profile(indexed).collect()}
    assert (demand["zero"].adi, demand["zero"].cv2, demand["zero"].is_intermittent) == (30.0, 0.0, True)
    assert demand["alternating"].adi == 2.0 and demand["one_late"].adi == 30.0
    assert not demand["flat"].is_intermittent
    rare = np.array(handmade.SERIES["rare"])
    assert demand["rare"].cv2 == pytest.approx((rare[rare > 0].std() / rare[rare > 0].mean()) ** 2)
    growth = {r.series_key: r for r in profile.growth_profile(indexed).collect()}
    assert growth["n11"].trend_direction == "insufficient_data" and growth["n11"].recent_sum == 21.0
    assert growth["up"].trend_slope == pytest.approx(1.5) and growth["up"].has_growth
    assert growth["boom"].trend_direction == "accelerating"
    assert growth["zero"].yoy_growth_pct == 0.0 and growth["flat"].trend_direction == "stable"
    idx = [r.idx for r in profile.seasonal_index(indexed.where("series_key = 'seasonal'")).orderBy("phase").collect()]
    np.testing.assert_allclose(idx, handmade.season(handmade.SERIES["seasonal"]))


def brute_holt(v, horizon):
    """Every grid point on its own, one step at a time."""
    best = None
    x = np.arange(min(10, len(v)))
    slope, start = np.polyfit(x, v[:10], 1)
    for a, share, phi in fits.HOLT_GRID:
        level, b, sse = start - slope, slope, 0.0
        for y in v:
            f = level + phi * b
            sse += (y - f) ** 2
            level, b = f + a * (y - f), phi * b + a * share * (y - f)
        path = [level + b * sum(phi**i for i in range(1, h + 1)) for h in range(1, horizon + 1)]
        if best is None or sse < best[0] - 1e-12:
            best = (sse, path)
    return np.maximum(best[1], 0)


def brute_ar(v, horizon):
    d = np.diff(v)
    y, a, b = d[12:], d[11:-1], d[:-12]
    best = None
    for lags in ((1,), (12,), (1, 12)):
        x = np.stack([{1: a, 12: b}[k] for k in lags], axis=1)
        c = np.linalg.lstsq(x, y, rcond=None)[0]
        rss = max(float(((y - x @ c) ** 2).sum()), 1e-9)
        aic = len(y) * np.log(rss / len(y)) + 2 * len(lags)
        if best is None or aic < best[0]:
            best = (aic, dict(zip(lags, c)))
    past, last, out = list(d), v[-1], []
    for _ in range(horizon):
        step = sum(c * past[-k] for k, c in best[1].items())
        past.append(step)
        last += step
        out.append(last)
    return np.maximum(out, 0)


def fitted(values, horizon):
    n = np.array([len(values)])
    y = fits._padded(np.array([values], dtype=float))
    due = lambda t: np.flatnonzero(n == t)
    return {m: np.maximum(next(iter(f(y, due, horizon)))[2][0], 0) for m, f in fits._MODELS.items()}


@pytest.mark.parametrize("name", ["wave", "rare", "seasonal", "n31", "boom"])
def test_fits_match_brute_force(indexed, name):
    v = np.array(handmade.SERIES[name])
    state = fits.fitted_at_end(series_state(indexed.where(F.col("series_key") == name), cfg=CFG))
    got = state.select("fits.*").first()
    np.testing.assert_allclose(got.iets, brute_holt(v, 12), rtol=1e-6, atol=1e-6)
    if name != "seasonal":  # differences are exactly periodic there: several fits are perfect
        np.testing.assert_allclose(got.arima, brute_ar(v, 12), rtol=1e-5, atol=1e-5)


def test_holt_winters_follows_the_season():
    path = fitted(handmade.SERIES["seasonal"], 12)["holt_winters"]
    np.testing.assert_allclose(path, handmade.SERIES["seasonal"][:12], atol=2.5)
    assert max(fitted(handmade.SERIES["rare"], 12)["holt_winters"]) < 200


def test_rolling_fits_equal_refits_at_every_origin(indexed):
    v = handmade.SERIES["rare"]
    state = series_state(indexed.where("series_key = 'rare'"), cfg=CFG)
    rows = fits.fitted_rolling(state).collect()
    assert {r.origin for r in rows} == set(range(24, len(v) - 3))
    for origin in (24, 40, len(v) - 4):
        want = fitted(v[:origin], 3)
        for r in rows:
            if r.origin == origin:
                for m in fits.FITTED:
                    assert r[m] == pytest.approx(want[m][r.h - 1], rel=1e-6, abs=1e-6)


def test_meta_training_rows(indexed):
    rows = meta.rolling_origins(indexed.where("series_key in ('rare', 'n24', 'n31')")).collect()
    v = np.array(handmade.SERIES["rare"])
    assert {r.series_key for r in rows} == {"rare", "n31"}
    for r in rows:
        if r.series_key == "rare":
            scale = v[: r.origin].mean()
            assert r.label == pytest.approx(v[r.origin + r.h - 1] / scale)
            assert r.f_last == pytest.approx(v[r.origin - 1] / scale)
            assert r.f_last6 == pytest.approx(v[r.origin - 6 : r.origin].mean() / scale)
            es = handmade.opinions(v[: r.origin], 3)["exp_smoothing"][r.h - 1]
            assert r.f_exp_smoothing == pytest.approx(es / scale)


def test_meta_learner_sees_only_the_train_part(indexed, monkeypatch):
    seen = {}

    def spy(rows, cfg):
        seen["origins"] = {r.series_key: r.m for r in rows.groupBy("series_key").agg(F.max("origin").alias("m")).collect()}
        return object()

    monkeypatch.setattr(meta, "train", spy)
    meta.trained_metas(indexed.where("series_key = 'wave'"), CFG, meta.before_holdout)
    assert seen["origins"] == {"wave": 48 - 4}


def test_post_processing(indexed):
    wide = post.finished(combine.closed_methods(series_state(indexed, cfg=CFG), CFG), combine.CLOSED)
    paths = collect_paths(wide, ("ma_benchmark", "tsb"))
    up = np.array(handmade.SERIES["up"])
    assert paths["up", "ma_benchmark"] == pytest.approx(list(up[-3:].mean() + 1.5 * np.arange(1, 13)))
    assert paths["flat", "ma_benchmark"] == pytest.approx([12.0] * 12)
    boom = np.array(handmade.SERIES["boom"])
    raw = handmade.opinions(boom, 12)["ma_benchmark"] + np.polyfit(np.arange(47), boom, 1)[0] * np.arange(1, 13)
    recent = boom[-12:].sum()
    factor = min(0.88 * recent / raw.sum(), 1.5) if raw.sum() < 0.7 * recent else 1.0
    assert paths["boom", "ma_benchmark"] == pytest.approx(list(raw * factor))


def test_noise_is_seeded(indexed):
    wide = combine.closed_methods(series_state(indexed.where("series_key = 'flat'")))
    runs = [collect_paths(post.finished(wide, combine.CLOSED, EngineConfig(noise=True, seed=s)), ("tsb",))["flat", "tsb"] for s in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2] and np.std(runs[0]) > 0


def test_backtest(indexed):
    wide = combine.closed_methods(series_state(indexed, "holdout", cfg=CFG))
    got = {(r.series_key, r.method): r for r in backtest.backtest_metrics(wide, combine.CLOSED).collect()}
    assert not any(k[0] in ("n11", "n12", "n23") for k in got)
    v = np.array(handmade.SERIES["wave"])
    train, actual = v[:-12], v[-12:]
    fc = handmade.opinions(train, 12)["croston"]
    row = got["wave", "croston"]
    assert row.mae == pytest.approx(abs(actual - fc).mean())
    assert row.rmse == pytest.approx(np.sqrt(((actual - fc) ** 2).mean()))
    assert row.smape == pytest.approx((abs(actual - fc) / ((abs(actual) + abs(fc)) / 2)).mean() * 100)
    assert row.bias_pct == pytest.approx((fc - actual).mean() / actual.mean() * 100)
    assert row.score_pct == pytest.approx(row.mae_pct + abs(row.bias_pct))
    assert row.mase == pytest.approx(row.mae / abs(np.diff(train)).mean())
    rare = np.array(handmade.SERIES["rare"])
    assert got["rare", "adida"].mase == pytest.approx(got["rare", "adida"].mae / abs(np.diff(rare[:-15])).mean())
    zero = got["zero", "croston"]
    assert (zero.mae, zero.smape, zero.score_pct, zero.status) == (0.0, 100.0, None, "empty")
    metrics = backtest.backtest_metrics(wide, combine.CLOSED)
    best = {r.series_key: r.method for r in backtest.best_method(metrics).collect()}
    assert best["zero"] == "croston"  # ties go to the first method
    for key, method in best.items():
        mine = got[key, method].smape
        assert all(mine <= r.smape + 1e-8 for (k, _), r in got.items() if k == key)
    by_mae = {r.series_key for r in backtest.best_method(metrics, "mae").collect()}
    assert "zero" not in by_mae
    assert "zero" in {r.series_key for r in backtest.best_method(metrics, "mae", compat=True).collect()}
    compat = {(r.series_key, r.method): r for r in backtest.backtest_metrics(wide, combine.CLOSED, True).collect()}
    assert compat["wave", "prophet"].mae == pytest.approx(abs(actual - handmade.opinions(train, 12)["exp_smoothing"]).mean())


def test_smart_calibration_keeps_short_series(indexed):
    wide = closed_form.with_closed_forms(closed_form.steps(closed_form.levels(series_state(indexed, horizon=12))))
    got = collect_paths(combine.with_smart_calibration(wide, "croston"), ("croston", "croston_calibrated"))
    assert got["n23", "croston"] == got["n23", "croston_calibrated"]
    v = np.array(handmade.SERIES["down"])
    path = np.array(got["down", "croston"])
    target = v[24:36].sum() * (1 - 0.05)
    want = target / 12 * v[-12:] / v[-12:].mean() if abs(path.sum() - target) / target > 0.35 else path
    np.testing.assert_allclose(got["down", "croston_calibrated"], want)


def test_bootstrap(indexed):
    state = series_state(indexed.where("series_key in ('rare', 'zero')"))
    one, two = (sorted(map(tuple, report.bootstrap(s, 50).collect())) for s in (state, state.repartition(3)))
    assert one == two and len(one) == 2 * 50 * 12
    drawn = [r[3] for r in one if r[0] == "rare"]
    v = np.array(handmade.SERIES["rare"])
    share = np.mean([x > 0 for x in drawn])
    assert abs(share - (v > 0).mean()) < 0.06
    assert max(drawn) <= v.max() * 1.2 and all(r[3] == 0 for r in one if r[0] == "zero")


def test_full_run(spark, indexed):
    rows = [(k, dt.datetime.combine(month(t), dt.time(8)), float(x)) for k, v in handmade.SERIES.items() for t, x in enumerate(v)]
    lines = spark.createDataFrame(rows, "sku string, booked_date timestamp_ntz, qty double")
    run = forecasting.forecast(lines, "item", horizon=6)
    status = {r.series_key: (r.status, r.reason) for r in run.status.collect()}
    assert status["n11"] == ("insufficient", "history of 11 periods is shorter than 12")
    assert status["zero"][0] == "zero" and status["n12"][0] == "ok"
    got = run.forecasts.groupBy("series_key").agg(F.countDistinct("method").alias("m"), F.count_if(F.col("yhat").isNull()).alias("bad")).collect()
    assert {r.series_key for r in got} == set(handmade.SERIES) - {"n11", "zero"}
    assert all(r.m == len(METHODS) and r.bad == 0 for r in got)
    report_rows = run.report.where("type = 'Forecast'").collect()
    best = {r.series_key: r.method for r in run.best.collect()}
    assert len(report_rows) == 6 * (len(handmade.SERIES) - 2)
    for r in report_rows:
        assert r.method == best.get(r.series_key, "intelligent_growth")
    first = [r.period for r in report_rows if r.series_key == "n12"]
    assert sorted(first) == [f"2016-{m:02d}" for m in range(1, 7)]
    assert run.report.where("series_key = 'rare' AND type = 'Historical'").count() == 77
    totals = {r.series_key: r for r in report.report_totals(run.report).collect()}
    assert totals["flat"].historical_total == 36 * 12.0


def test_method_ranking_per_series(spark):
    rows = [("a", "m1", 0, 2.0, 5.0), ("a", "m2", 1, 1.0, 6.0), ("a", "m3", 2, None, 0.0), ("b", "m1", 0, 3.0, 1.0), ("b", "m2", 1, 3.0, 2.0)]
    df = spark.createDataFrame(rows, "series_key string, method string, method_ord int, score_pct double, mae double")
    got = [tuple(r)[:3] for r in backtest.method_ranking(df, k=2).orderBy("series_key", "rank").collect()]
    assert got == [("a", 1, "m2"), ("a", 2, "m1"), ("b", 1, "m1"), ("b", 2, "m2")]
    assert backtest.method_ranking(df, skip=("m2",)).where("method = 'm2'").count() == 0
