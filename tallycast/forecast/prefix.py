"""State of the closed forms after every step of a series, by prefix scans.

One row per step carries what a forecast from the next step needs, so a rolling origin is a row and not a copy of its
history: time and rows are linear in the length of a series.

The scans are array operations over a batch of zero-filled series (``scans``): running counts and sums, and sums of the
last few steps. Exponential smoothing is a decayed sum, but its factor depends on the origin (0.3 to 0.5, by
the volatility of the last 12 steps). All origins are folded at once, from DEPTH steps back: what is older weighs below
0.7^DEPTH = 1e-20. Where negative demand takes the factor out of that interval, the whole history is folded.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.functions.columns import add

DEPTH = 128
LOW, HIGH = 0.3, 0.5
FIRST = 12  # shortest prefix that has all windows
BATCH = 2048  # series per NumPy pass

_BY_T = "PARTITION BY series_key ORDER BY t"


def dense_steps(indexed: DataFrame) -> DataFrame:
    """``(series_key, t, n, v)`` with a row for every step: each row is unfolded up to the next one or the end."""
    df = add(indexed.select("series_key", "t", "n", "value"), {"upto": f"coalesce(lead(t) OVER ({_BY_T}), n)"})
    return df.selectExpr("series_key", "n", "value", "t AS own", "explode(sequence(t, upto - 1)) AS t").selectExpr(
        "series_key", "CAST(t AS INT) AS t", "CAST(n AS INT) AS n", "if(t = own, value, 0D) AS v"
    )


def dense_matrix(steps: pd.Series, values: pd.Series, lengths: np.ndarray) -> np.ndarray:
    """Sparse (step, value) lists as one zero-filled matrix, a row per series."""
    out = np.zeros((len(lengths), int(lengths.max(initial=1))))
    sizes = np.fromiter((len(s) for s in steps), dtype=np.int64, count=len(steps))
    rows = np.repeat(np.arange(len(lengths)), sizes)
    if len(rows):
        out[rows, np.concatenate(steps.to_list())] = np.concatenate(values.to_list())
    return out


def _trailing(y: np.ndarray, k: int, skip: int = 0) -> np.ndarray:
    """Sum of the last k values up to each step, or up to ``skip`` steps before it; nothing stands before the first step."""
    past = np.pad(y, ((0, 0), (k + skip - 1, 0)))
    return sum(past[:, i : i + y.shape[1]] for i in range(k))


def _spread(y: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Standard deviation of the last 12 values up to each step around their mean."""
    past = np.pad(y, ((0, 0), (FIRST - 1, 0)))
    return np.sqrt(sum((past[:, i : i + y.shape[1]] - mean) ** 2 for i in range(FIRST)) / FIRST)


def _folded(y: np.ndarray, alpha: np.ndarray, depth: int) -> np.ndarray:
    """Smoothed level after each step with the step's own factor, folded over its last ``depth`` values."""
    level, keep = np.zeros_like(y), 1 - alpha
    for back in range(min(depth, y.shape[1]) - 1, -1, -1):
        level[:, back:] = alpha[:, back:] * y[:, : y.shape[1] - back] + keep[:, back:] * level[:, back:]
        level[:, back] = y[:, 0]
    return level


def scans(y: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics (rows, steps) of the prefix that ends with each step; columns as in ``closed_form.levels``.

    They hold from the FIRST-th step on. Padding after the end of a row does not reach back.
    """
    m12 = _trailing(y, FIRST) / FIRST
    sd12 = _spread(y, m12)
    with np.errstate(all="ignore"):
        alpha = LOW + (HIGH - LOW) * np.exp(-np.divide(sd12, m12 + 1, out=np.zeros_like(m12), where=m12 != -1))
        level = _folded(y, alpha, DEPTH)
        wild = np.flatnonzero((alpha[:, FIRST - 1 :] > HIGH).any(axis=1))
        if len(wild):
            level[wild] = np.where(alpha[wild] > HIGH, _folded(y[wild], alpha[wild], y.shape[1]), level[wild])
    trend3 = (_trailing(y, 3) - _trailing(y, 3, 3)) / 9
    return {
        "nnz": np.cumsum(y > 0, axis=1),
        "mean_v": np.cumsum(y, axis=1) / np.arange(1, y.shape[1] + 1),
        "last_v": y,
        "last6": _trailing(y, 6),
        "es_level": level,
        "es_trend": np.minimum(np.maximum(trend3, level * -0.15), level * 0.15),
    }


def _prefix_batches(batches: Iterator[pd.DataFrame], ahead: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lo in range(0, len(batch), BATCH):
            part = batch.iloc[lo : lo + BATCH]
            n = part["n"].to_numpy()
            y = dense_matrix(part["hist_t"], part["hist_v"], n)
            row, t = np.nonzero((np.arange(y.shape[1]) >= FIRST - 1) & (np.arange(y.shape[1]) < n[:, None]))
            out = {"series_key": part["series_key"].to_numpy()[row], "origin": t + 1, "n": t + 1, "full_n": n[row]}
            out |= {name: a[row, t] for name, a in scans(y).items()}
            for k in range(1, ahead + 1):
                after = np.where(t + k < n[row], y[row, np.minimum(t + k, y.shape[1] - 1)], np.nan)
                out[f"next{k}"] = pd.Series(after).astype("Float64").mask(t + k >= n[row])
            yield pd.DataFrame(out)


def prefix_states(indexed: DataFrame, ahead: int) -> DataFrame:
    """Statistics of each prefix of 12 steps or more: ``origin`` is its length, ``n`` too, ``full_n`` the series' length.

    Columns as in ``closed_form.levels``, and ``next1`` .. the values of the ``ahead`` steps that follow.
    """
    whole = indexed.groupBy("series_key").agg(
        F.max("n").cast("int").alias("n"), F.collect_list("t").alias("hist_t"), F.collect_list("value").alias("hist_v")
    )
    following = ", ".join(f"next{k} double" for k in range(1, ahead + 1))
    schema = f"series_key string, origin int, n int, full_n int, nnz long, mean_v double, last_v double, last6 double, es_level double, es_trend double, {following}"
    return whole.mapInPandas(lambda batches: _prefix_batches(batches, ahead), schema)


# The functions travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
