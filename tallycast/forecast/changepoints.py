"""Trend with change points and a season of harmonics: ridge regression on a fixed basis, one solve per length.

The basis of a series depends on its length only: a constant, a line, hinges (lines that start at a change point) and
harmonics of the season. So the Gram matrix is the same for all series of one length and branch, and what a series adds
is the sum of its sparse rows times each basis function, which is one aggregate of its state. Spark hands over those
sums in Arrow batches; each batch solves every (length, branch) it holds once, for all of its series.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.forecast.state import HINGES, SEASON, hinge_at
from tallycast.functions.columns import add

# Changes in level (last against first year) that pick the branch, and how freely slope and season may move.
STRONG_GROWTH, STRONG_DECLINE = 0.5, -0.3
FREEDOM = {"changing": 0.1, "linear": 0.05}
SEASON_FREEDOM = 15.0
#: Noise that the freedoms are measured against, as a share of the series' scale. On held-out synthetic demand, 0.05 gained on
#: bent trends and lost next to nothing on straight and trendless ones; smaller values follow noise, larger ones miss bends.
NOISE = 0.05
WAVES = 3
LEAST = 3  # steps; shorter histories are forecast by their mean
BASIS = 2 + HINGES + 2 * WAVES

CHANGE = "try_divide(m12 - first12 / least(n, 12), first12 / least(n, 12) + 1)"
BRANCH = f"CASE WHEN {CHANGE} > {STRONG_GROWTH}D THEN 'changing' WHEN {CHANGE} < {STRONG_DECLINE}D THEN 'flat' ELSE 'linear' END"


def basis(n: int, t: np.ndarray) -> np.ndarray:
    """Values of the basis of a history of ``n`` steps at the steps ``t``, a column for each function."""
    x = t / max(n - 1, 1)
    bends = [np.maximum(x - hinge_at(j), 0.0) for j in range(HINGES)]
    return np.column_stack([np.ones_like(x), x, *bends, *_waves(t)])


def _waves(t: np.ndarray) -> list[np.ndarray]:
    angle = [2 * math.pi * k * (t % SEASON) / SEASON for k in range(1, WAVES + 1)]
    return [f(a) for a in angle for f in (np.cos, np.sin)]


def penalties(n: int, branch: str) -> tuple[np.ndarray, np.ndarray]:
    """Basis functions in use, and the weight on the square of each coefficient."""
    used, ridge = np.ones(BASIS, dtype=bool), np.zeros(BASIS)
    if branch == "flat":
        used[1 : 2 + HINGES] = False
    else:
        ridge[2 : 2 + HINGES] = (NOISE / FREEDOM[branch]) ** 2
    used[2 + HINGES :] = n >= 2 * SEASON
    ridge[2 + HINGES :] = (NOISE / SEASON_FREEDOM) ** 2
    return used, ridge


def solved(n: int, branch: str, sums: np.ndarray) -> np.ndarray:
    """Coefficients of series of one length and branch; ``sums`` has a row of basis sums for each."""
    out = np.zeros((len(sums), BASIS))
    if n < LEAST:
        out[:, 0] = sums[:, 0] / max(n, 1)
        return out
    used, ridge = penalties(n, branch)
    x = basis(n, np.arange(n))[:, used]
    out[:, used] = np.linalg.solve(x.T @ x + np.diag(ridge[used]), sums[:, used].T).T
    return out


def _fit():
    """UDF: coefficients out of length, branch, and the sums of values times (1, t, hinges, phases)."""

    def fit(lengths: pd.Series, branches: pd.Series, moments: pd.Series) -> pd.Series:
        if not len(lengths):
            return pd.Series([], dtype=object)
        n, kind, m = lengths.to_numpy(), branches.to_numpy(), np.stack(moments.to_list())
        waves = np.column_stack(_waves(np.arange(SEASON)))
        scale = np.maximum(n - 1, 1)[:, None]
        sums = np.column_stack([m[:, :1], m[:, 1 : 2 + HINGES] / scale, m[:, 2 + HINGES :] @ waves])
        out = np.zeros((len(n), BASIS))
        for length, branch in set(zip(n.tolist(), kind.tolist())):
            rows = (n == length) & (kind == branch)
            out[rows] = solved(length, branch, sums[rows])
        return pd.Series(list(out))

    return F.pandas_udf(fit, T.ArrayType(T.DoubleType()))


def with_trend_basis(state: DataFrame) -> DataFrame:
    """Add ``trend_branch`` (flat, linear or changing) and ``trend_coef``, the coefficients of the basis."""
    parts = ["sum_all", "tv", *(f"hinge{j}" for j in range(HINGES)), *(f"phase_all{i}" for i in range(SEASON))]
    moments = F.array(*[F.col(p).cast("double") for p in parts])
    return add(state, {"trend_branch": BRANCH}).withColumn("trend_coef", _fit()("n", "trend_branch", moments))


def trend_expression() -> str:
    """SQL of the forecast at step ``h``."""
    x = "((n + h - 1) / greatest(n - 1, 1))"
    terms = ["get(trend_coef, 0)", f"get(trend_coef, 1) * {x}"]
    terms += [f"get(trend_coef, {2 + j}) * greatest({x} - {hinge_at(j)!r}D, 0D)" for j in range(HINGES)]
    for k in range(WAVES):
        angle = f"({2 * math.pi * (k + 1) / SEASON!r}D * ((n + h - 1) % {SEASON}))"
        terms += [f"get(trend_coef, {2 + HINGES + 2 * k + i}) * {f}({angle})" for i, f in enumerate(("cos", "sin"))]
    return f"greatest({' + '.join(terms)}, 0D)"


def trend_segments(state: DataFrame) -> DataFrame:
    """Slopes between change points: rows ``(series_key, branch, segment, from_step, slope)``, slopes in units a period.

    Segment 0 starts at step 0, segment j at the j-th change point (a real number of steps). Histories under three steps
    have no slope and count as flat throughout.
    """
    rows = with_trend_basis(state).select("series_key", "n", "trend_branch", "trend_coef")
    starts = ", ".join(["0D", *(f"{hinge_at(j)!r}D" for j in range(HINGES))])
    rows = rows.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(HINGES))))
    slope = "aggregate(slice(trend_coef, 2, segment + 1), 0D, (total, c) -> total + c) / greatest(n - 1, 1)"
    return rows.selectExpr(
        "series_key", "trend_branch AS branch", "segment",
        f"get(array({starts}), segment) * (n - 1) AS from_step", f"{slope} AS slope",
    )


# The functions travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
