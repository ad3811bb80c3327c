"""Fitted methods: damped-trend smoothing, Holt-Winters, seasonal autoregression with or without moving averages.

These recursions have free parameters, so they have no closed form. Spark hands over
Arrow batches of series; NumPy runs every (series, parameter set) pair of the batch at
once and loops over time only. The error of a parameter set is summed as time goes on,
so the best set is known at *any* origin after one pass.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.forecast.prefix import dense_matrix, scans
from tallycast.forecast.smoothing import smoothing_family
from tallycast.forecast.state import ROLLING_START, ROLLING_STEPS, SEASON

FITTED = ("iets", "holt_winters", "arima")
CHUNK = 2048  # series per NumPy pass, keeps the state arrays in cache
TINY = 1e-9
SEASON_FLOOR = 0.05

HOLT_GRID = np.array(list(product((0.05, 0.1, 0.2, 0.3, 0.5), (0.02, 0.1, 0.3), (0.8, 0.9, 0.95, 0.98))))
WINTERS_GRID = np.array(list(product((0.05, 0.15, 0.3, 0.5), (0.02, 0.1), (0.05, 0.15, 0.3), (0.9, 0.98))))

Due = Callable[[int], np.ndarray]  # rows that want a forecast from the first t values
Fit = Iterator[tuple[np.ndarray, int, np.ndarray]]  # (rows, t, forecasts)


def _first_line(y: np.ndarray, points: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Level before the first step and slope of a line through the first points."""
    head = y[:, :points]
    x = np.arange(head.shape[1]) - (head.shape[1] - 1) / 2
    slope = head @ x / max(float(x @ x), 1.0)
    return head.mean(axis=1) + slope * (x[0] - 1), slope


def _best(error: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.argmin(error[rows], axis=1)


def _damped_path(level: np.ndarray, slope: np.ndarray, phi: np.ndarray, horizon: int) -> np.ndarray:
    powers = phi[:, None] ** np.arange(1, horizon + 1)
    return level[:, None] + slope[:, None] * np.cumsum(powers, axis=1)


def damped_trend(y: np.ndarray, due: Due, horizon: int) -> Fit:
    """Damped-trend exponential smoothing, best of the grid by squared one-step error."""
    alpha, share, phi = HOLT_GRID.T
    beta = alpha * share
    level, slope = (np.repeat(a[:, None], len(phi), axis=1) for a in _first_line(y))
    error = np.zeros_like(level)
    for t in range(y.shape[1] + 1):
        rows = due(t)
        if len(rows):
            g = _best(error, rows)
            yield rows, t, _damped_path(level[rows, g], slope[rows, g], phi[g], horizon)
        if t == y.shape[1]:
            return
        ahead = level + phi * slope
        miss = y[:, t, None] - ahead
        error += miss * miss
        level = ahead + alpha * miss
        slope = phi * slope + beta * miss


def holt_winters(y: np.ndarray, due: Due, horizon: int) -> Fit:
    """Additive season on y against multiplicative season on y + 1; the lower AIC wins.

    Both have the same number of parameters and steps, so the AIC order is the order of
    the squared errors.
    """
    alpha, share, gamma, phi = WINTERS_GRID.T
    cycle1, cycle2 = y[:, :SEASON].mean(axis=1), y[:, SEASON : 2 * SEASON].mean(axis=1)
    slope0 = (cycle2 - cycle1) / SEASON
    grid = len(phi)
    models = []
    for shift, times in ((0.0, False), (1.0, True)):
        z = y + shift
        base1, base2 = cycle1 + shift, cycle2 + shift
        if times:
            ratios = [
                z[:, i * SEASON : (i + 1) * SEASON] / np.maximum(base, TINY)[:, None] for i, base in enumerate((base1, base2))
            ]
            first = np.maximum((ratios[0] + ratios[1]) / 2, SEASON_FLOOR)
        else:
            first = (z[:, :SEASON] - base1[:, None] + z[:, SEASON : 2 * SEASON] - base2[:, None]) / 2
        models.append(
            {
                "z": z,
                "shift": shift,
                "times": times,
                "level": np.repeat(base1[:, None], grid, axis=1),
                "slope": np.repeat(slope0[:, None], grid, axis=1),
                "season": np.repeat(first[:, :, None], grid, axis=2),
                "error": np.zeros((len(y), grid)),
            }
        )
    for t in range(y.shape[1] + 1):
        rows = due(t)
        if len(rows):
            paths, scores = [], []
            for m in models:
                g = _best(m["error"], rows)
                path = _damped_path(m["level"][rows, g], m["slope"][rows, g], phi[g], horizon)
                phase = (t + np.arange(horizon)) % SEASON
                season = m["season"][rows[:, None], phase[None, :], g[:, None]]
                paths.append(path * season - m["shift"] if m["times"] else path + season)
                scores.append(m["error"][rows, g])
            yield rows, t, np.where((scores[0] < scores[1])[:, None], paths[0], paths[1])
        if t == y.shape[1]:
            return
        i = t % SEASON
        for m in models:
            z, season = m["z"][:, t, None], m["season"][:, i, :]
            base = m["level"] + phi * m["slope"]
            if m["times"]:
                base = np.maximum(base, TINY)
                ahead = base * season
                level = alpha * z / season + (1 - alpha) * base
                fresh = z / np.maximum(level, TINY)
            else:
                ahead = base + season
                level = alpha * (z - season) + (1 - alpha) * base
                fresh = z - level
            m["slope"] = share * (level - m["level"]) + (1 - share) * phi * m["slope"]
            m["level"] = level
            blended = gamma * fresh + (1 - gamma) * season
            m["season"][:, i, :] = np.maximum(blended, SEASON_FLOOR) if m["times"] else blended
            m["error"] += (z - ahead) ** 2


def seasonal_ar(y: np.ndarray, due: Due, horizon: int) -> Fit:
    """First differences on lags {1}, {12}, {1, 12}: least squares from running cross-moments, AIC pick."""
    diff = np.diff(y, axis=1, prepend=y[:, :1])
    moments = np.zeros((6, len(y)))  # d*d, d*a, d*b, a*a, b*b, a*b with a = lag 1 and b = lag 12
    count = 0
    for t in range(y.shape[1] + 1):
        rows = due(t)
        if len(rows):
            dd, da, db, aa, bb, ab = moments[:, rows]
            zero = np.zeros_like(dd)
            one = np.divide(da, aa, out=zero.copy(), where=aa > TINY)
            twelve = np.divide(db, bb, out=zero.copy(), where=bb > TINY)
            det = aa * bb - ab * ab
            solvable = det > TINY * np.maximum(aa * bb, TINY)
            both1 = np.divide(da * bb - db * ab, det, out=zero.copy(), where=solvable)
            both12 = np.divide(db * aa - da * ab, det, out=zero.copy(), where=solvable)
            c1, c12 = np.stack([one, zero, both1]), np.stack([zero, twelve, both12])
            rss = dd - 2 * (c1 * da + c12 * db) + c1 * c1 * aa + c12 * c12 * bb + 2 * c1 * c12 * ab
            size = np.array([1, 1, 2])[:, None]
            aic = max(count, 1) * np.log(np.maximum(rss, TINY) / max(count, 1)) + 2 * size
            pick = np.argmin(aic, axis=0)
            w1, w12 = c1[pick, np.arange(len(rows))], c12[pick, np.arange(len(rows))]
            past = np.concatenate([np.zeros((len(rows), max(0, SEASON - t))), diff[rows, max(0, t - SEASON) : t]], axis=1)
            path = np.empty((len(rows), horizon))
            last = y[rows, t - 1] if t else np.zeros(len(rows))
            for h in range(horizon):
                step = w1 * past[:, -1] + w12 * past[:, -SEASON]
                past = np.concatenate([past[:, 1:], step[:, None]], axis=1)
                last = last + step
                path[:, h] = last
            yield rows, t, path
        if t == y.shape[1]:
            return
        if t >= SEASON + 1:
            d, a, b = diff[:, t], diff[:, t - 1], diff[:, t - SEASON]
            moments += np.stack([d * d, d * a, d * b, a * a, b * b, a * b])
            count += 1


# Lags of the order search: of the differences, and of their innovations. An order is a set of each.
VALUE_LAGS, SHOCK_LAGS = (1, 2, SEASON), (1, SEASON)
LONG_LAGS = (1, 2, SEASON, SEASON + 1)
VALUE_SETS = ((), (1,), (SEASON,), (1, SEASON), (1, 2), (1, 2, SEASON))
SHOCK_SETS = ((), (1,), (SEASON,), (1, SEASON))
_TERMS = [("value", k) for k in VALUE_LAGS] + [("shock", k) for k in SHOCK_LAGS]
ORDERS = [[_TERMS.index(("value", k)) for k in a] + [_TERMS.index(("shock", k)) for k in b] for a in VALUE_SETS for b in SHOCK_SETS]
MOST_PERSISTENT = 0.98


def _solved(gram: np.ndarray, cross: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Coefficients of least squares for each row, with a share of the mean square of the regressors on the diagonal."""
    k = gram.shape[-1]
    scale = np.einsum("...ii->...", gram) / k
    return np.linalg.solve(gram + (ridge * scale + TINY)[:, None, None] * np.eye(k), cross[..., None])[..., 0]


def seasonal_arma(y: np.ndarray, due: Due, horizon: int) -> Fit:
    """First differences on lags of themselves and of their innovations; the order with the least AICc.

    Two stages of least squares. A long autoregression, solved anew at each step from what came before, predicts the
    step; what it misses is the step's innovation. All orders are then regressions on differences and innovations, so
    that running cross-moments of five regressors hold every order at any origin, and a pass is linear in the history.
    The ridge is one observation's weight for the long autoregression. Differences' coefficients that add up to more
    than 0.98 in size are scaled down, so paths do not run away.
    """
    rows_all, length = y.shape
    diff = np.diff(y, axis=1, prepend=y[:, :1])
    shock = np.zeros_like(diff)
    start, k, m = SEASON + 1, len(_TERMS), len(LONG_LAGS)
    long_gram, long_cross = np.zeros((rows_all, m, m)), np.zeros((rows_all, m))
    gram, cross, total = np.zeros((rows_all, k, k)), np.zeros((rows_all, k)), np.zeros(rows_all)
    count = 0

    def at(a: np.ndarray, t: int, lag: int) -> np.ndarray:
        return a[:, t - lag] if t >= lag else np.zeros(rows_all)

    for t in range(length + 1):
        rows = due(t)
        if len(rows):
            coefficients, scores = np.zeros((len(ORDERS), len(rows), k)), np.full((len(ORDERS), len(rows)), np.inf)
            for o, order in enumerate(ORDERS):
                size = len(order) + 1
                if order:
                    g, c = gram[np.ix_(rows, order, order)], cross[np.ix_(rows, order)]
                    coefficients[o][:, order] = _solved(g, c, np.full(len(rows), 1e-6))
                if count > size + 1:
                    b = coefficients[o]
                    rss = total[rows] - 2 * (b * cross[rows]).sum(1) + np.einsum("ri,rij,rj->r", b, gram[rows], b)
                    scores[o] = count * np.log(np.maximum(rss, TINY) / count) + 2 * size + 2 * size * (size + 1) / (count - size - 1)
            b = coefficients[np.argmin(scores, axis=0), np.arange(len(rows))]
            heavy = np.abs(b[:, : len(VALUE_LAGS)]).sum(1)
            b[:, : len(VALUE_LAGS)] *= np.where(heavy > MOST_PERSISTENT, MOST_PERSISTENT / np.maximum(heavy, TINY), 1.0)[:, None]
            past = np.concatenate([np.zeros((len(rows), max(0, SEASON - t))), diff[rows, max(0, t - SEASON) : t]], axis=1)
            missed = np.concatenate([np.zeros((len(rows), max(0, SEASON - t))), shock[rows, max(0, t - SEASON) : t]], axis=1)
            path, last = np.empty((len(rows), horizon)), y[rows, t - 1] if t else np.zeros(len(rows))
            for h in range(horizon):
                terms = [past[:, -lag] for lag in VALUE_LAGS] + [missed[:, -lag] for lag in SHOCK_LAGS]
                step = (b * np.stack(terms, axis=1)).sum(1)
                past = np.concatenate([past[:, 1:], step[:, None]], axis=1)
                missed = np.concatenate([missed[:, 1:], np.zeros((len(rows), 1))], axis=1)
                last = last + step
                path[:, h] = last
            yield rows, t, path
        if t == length:
            return
        if t >= start:
            z = np.stack([at(diff, t, lag) for lag in LONG_LAGS], axis=1)
            shock[:, t] = diff[:, t] - (_solved(long_gram, long_cross, np.full(rows_all, 1 / max(count, 1))) * z).sum(1)
            long_gram += z[:, :, None] * z[:, None, :]
            long_cross += z * diff[:, t, None]
            x = np.stack([at(diff if kind == "value" else shock, t, lag) for kind, lag in _TERMS], axis=1)
            gram += x[:, :, None] * x[:, None, :]
            cross += x * diff[:, t, None]
            total += diff[:, t] ** 2
            count += 1


_MODELS = {"iets": damped_trend, "holt_winters": holt_winters, "arima": seasonal_ar, "arma": seasonal_arma, "family": smoothing_family}


def _models(ma_terms: bool, family: bool = False) -> dict[str, str]:
    """Method slot -> model that fills it."""
    return {"iets": "family" if family else "iets", "holt_winters": "holt_winters", "arima": "arma" if ma_terms else "arima"}


def _padded(y: np.ndarray) -> np.ndarray:
    """At least two seasons of columns, so that short rows of a batch can share the code."""
    short = 2 * SEASON - y.shape[1]
    return np.pad(y, ((0, 0), (0, short))) if short > 0 else y


def _at_end(name: str):
    """UDF of one fitted method: its forecasts from the end of each history."""

    def fit(steps: pd.Series, values: pd.Series, lengths: pd.Series, horizons: pd.Series) -> pd.Series:
        n, horizon = lengths.to_numpy(), horizons.to_numpy()
        out = [None] * len(n)
        for lo in range(0, len(n), CHUNK):
            part = slice(lo, lo + CHUNK)
            size = n[part]
            y = _padded(dense_matrix(steps[part], values[part], size))
            for rows, _, path in _MODELS[name](y, lambda t, size=size: np.flatnonzero(size == t), int(horizon[part].max())):
                for r, values_ in zip(rows, np.maximum(path, 0.0)):
                    out[lo + r] = values_[: horizon[lo + r]]
        return pd.Series(out)

    return F.pandas_udf(fit, T.ArrayType(T.DoubleType()))


def fitted_at_end(state: DataFrame, ma_terms: bool = False, family: bool = False) -> DataFrame:
    """Add ``fits``: the forecasts of the fitted methods from the end of each row's history.

    Every method is a function of its own, so a query that reads one of them fits one. With ``ma_terms`` the slot
    ``arima`` searches orders with moving-average terms (``seasonal_arma``) instead of three autoregressions; with ``family`` the slot
    ``iets`` is ``smoothing_family`` instead of damped trends of a grid.
    """
    columns = [_at_end(model)("hist_t", "hist_v", "n", "horizon").alias(m) for m, model in _models(ma_terms, family).items()]
    return state.withColumn("fits", F.struct(*columns))


_STATISTICS = ("mean_v", "last_v", "last6", "es_level", "es_trend")
_STEPS = range(1, ROLLING_STEPS + 1)
_ORIGIN = {"origin": pa.int32(), "nnz": pa.int64()} | {
    name: pa.float64() for name in (*_STATISTICS, *(f"{kind}_{h}" for kind in (*FITTED, "actual") for h in _STEPS))
}
_NAMES = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double"}
ORIGINS_SCHEMA = f"origins array<struct<{', '.join(f'{name}:{_NAMES[kind]}' for name, kind in _ORIGIN.items())}>>"


def _rolling_batches(batches: Iterator[pa.RecordBatch], ma_terms: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            rows = batch.slice(lo, CHUNK)
            part = rows.select(["n", "hist_t", "hist_v", "due"]).to_pandas()
            y = _padded(dense_matrix(part["hist_t"], part["hist_v"], part["n"].to_numpy()))
            sizes = part["due"].str.len().to_numpy()
            row, origin = np.repeat(np.arange(len(part)), sizes), np.concatenate(part["due"].to_list())
            # Places of the origins of each step, and the rows they belong to.
            by_step = np.argsort(origin, kind="stable")
            ends = np.searchsorted(origin[by_step], np.arange(y.shape[1] + 2))

            def due(t: int, row: np.ndarray = row, by_step: np.ndarray = by_step, ends: np.ndarray = ends) -> np.ndarray:
                return row[by_step[ends[t] : ends[t + 1]]]

            last = int(origin.max(initial=0))
            columns = {"origin": origin} | {name: a[row, origin - 1] for name, a in scans(y[:, :last]).items()}
            for slot, model in zip(FITTED, _models(ma_terms).values()):
                paths = np.empty((len(origin), ROLLING_STEPS))
                for _, t, path in _MODELS[model](y[:, :last], due, ROLLING_STEPS):
                    paths[by_step[ends[t] : ends[t + 1]]] = path
                columns |= {f"{slot}_{h}": np.maximum(paths[:, h - 1], 0.0) for h in _STEPS}
            columns |= {f"actual_{h}": y[row, origin + h - 1] for h in _STEPS}
            found = pa.StructArray.from_arrays([pa.array(columns[name], kind) for name, kind in _ORIGIN.items()], list(_ORIGIN))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), found)
            kept = [name for name in rows.schema.names if name not in ("hist_t", "hist_v", "due")]
            yield pa.RecordBatch.from_arrays([*(rows.column(name) for name in kept), lists], [*kept, "origins"])


def rolling_paths(state: DataFrame, ma_terms: bool = False, due: Column | None = None, **extra: Column) -> DataFrame:
    """One row a series, ``(series_key, n, extra, origins)``: what the fitted methods forecast from each rolling origin, the
    statistics of the history before it (``prefix.scans``) and the steps that follow, in one pass per series.

    ``due`` lists the origins that are wanted, all by default; a series without any has no row and costs no fit. Rows
    stay in the partitions of ``state``, whose work is in Python and even, and no step is copied for an origin.
    """
    every = F.sequence(F.lit(ROLLING_START), F.col("n").cast("int") - ROLLING_STEPS - 1)
    long = state.where(F.col("n") - ROLLING_STEPS - 1 >= ROLLING_START)
    rows = long.select("series_key", F.col("n").cast("int").alias("n"), "hist_t", "hist_v", (every if due is None else due).alias("due"))
    rows = rows.where(F.size("due") > 0).withColumns(extra)
    kept = [field for field in rows.schema if field.name not in ("hist_t", "hist_v", "due")]
    schema = ", ".join([*(f"{field.name} {field.dataType.simpleString()}" for field in kept), ORIGINS_SCHEMA])
    return rows.mapInArrow(lambda batches: _rolling_batches(batches, ma_terms), schema)


def unfolded(paths: DataFrame, **by_step: str) -> DataFrame:
    """A row for each origin and step ``h`` of ``rolling_paths``; ``by_step`` names arrays with an entry for each step."""
    wide = paths.selectExpr("series_key", "n AS full_n", *by_step.values(), "inline(origins)")
    slots = (*FITTED, "actual", *by_step)
    entry = lambda slot, h: f"get({by_step[slot]}, {h - 1})" if slot in by_step else f"{slot}_{h}"
    steps = ", ".join(f"{h}, " + ", ".join(entry(slot, h) for slot in slots) for h in _STEPS)
    return wide.selectExpr(
        "series_key", "full_n", "origin", "nnz", *_STATISTICS, f"stack({ROLLING_STEPS}, {steps}) AS (h, {', '.join(slots)})"
    )


def fitted_rolling(state: DataFrame, ma_terms: bool = False) -> DataFrame:
    """Forecasts of the fitted methods at every rolling origin: ``(series_key, origin, h, methods)``."""
    return unfolded(rolling_paths(state, ma_terms)).select("series_key", "origin", "h", *FITTED)


# The functions travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
