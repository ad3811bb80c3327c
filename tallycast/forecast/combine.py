"""All methods side by side: one row per (series, origin, step), one column per method.

Ensembles are then arithmetic within the row, and the few facts about a whole forecast
(its sum, its spread) are windows over its steps, which all share one partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.config import ENSEMBLE_WEIGHTS, METHODS, EngineConfig
from tallycast.forecast.closed_form import GROWTH_BASE, levels, steps, with_closed_forms
from tallycast.forecast.fits import FITTED, fitted_at_end
from tallycast.functions.columns import add, hashed_uniform
from tallycast.operators.series import by_series

PATH = "(PARTITION BY series_key, origin)"
LONG_HISTORY = 24
# Fixed blend of the slot ``lstm``, and the blend of the meta-learner for short histories.
BLEND = {"holt_winters": 0.35, "arima": 0.25, "exp_smoothing": 0.20, "iets": 0.20}
META_SHORT = {"holt_winters": 0.4, "arima": 0.3, "exp_smoothing": 0.2, "iets": 0.1}
# Growth calibration.
GROWING, DECLINING = 0.15, -0.15
CAP_DECLINE, CAP_GROW, CAP_STABLE = -0.10, (0.03, 0.40), (-0.03, 0.08)
YEAR2_DAMPING = 0.75
TOLERANCE = 0.35
# Bounds of the optional calibration.
SMART_RATES = {
    "dying": "-0.5D",
    "declining": "least(wg, -0.05D)",
    "growing": "greatest(least(wg, 0.5D), 0.05D)",
    "stable": "greatest(least(wg, 0.1D), -0.05D)",
}
SMART_DAMPING = 0.7


def with_fitted(wide: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Add the fitted methods; short histories use exponential smoothing instead."""
    df = wide.withColumn("draw", hashed_uniform(cfg.seed, F.col("series_key"), F.col("h")))
    return add(
        df,
        {
            "iets": "CASE WHEN n < 12 THEN exp_smoothing WHEN draw > nnz / n THEN 0D ELSE get(fits.iets, h - 1) END",
            "holt_winters": f"if(n < {LONG_HISTORY}, exp_smoothing, get(fits.holt_winters, h - 1))",
            "arima": f"if(n < {LONG_HISTORY}, exp_smoothing, get(fits.arima, h - 1))",
        },
    ).drop("draw", "fits")


def blend(weights: dict[str, float]) -> str:
    """Weighted sum of method columns."""
    return "(" + " + ".join(f"{weight}D * {method}" for method, weight in weights.items()) + ")"


def with_fixed_blend(wide: DataFrame) -> DataFrame:
    """Slot ``lstm``: the fixed blend of four methods."""
    return add(wide, {"lstm": f"if(n < {LONG_HISTORY}, exp_smoothing, greatest({blend(BLEND)}, 0D))"})


def with_short_meta(wide: DataFrame) -> DataFrame:
    """Slot ``lightgbm`` without a trained model: the blend meant for short histories."""
    return add(wide, {"lightgbm": f"if(n < {LONG_HISTORY}, exp_smoothing, {blend(META_SHORT)})"})


def calibrated(
    wide: DataFrame, name: str, base: str, growth: str, rate: str, damping: float, unfit: str, fallback: str, open_end: bool = False
) -> DataFrame:
    """Pull a path to yearly targets where its yearly sum is off by more than the tolerance.

    The first-year target is the last complete block times ``1 + rate`` (an expression on
    ``wg``, the growth); the second grows from it by the damped growth. A year that is off
    becomes target / months times the shape of the last 12 steps. With ``open_end`` the
    second year takes in all steps past 12, and a history without level gives its own
    values as the shape; otherwise it ends at step 24 and the shape is flat.
    """
    second = "h > 12" if open_end else "h > 12 AND h <= 24"
    months2 = "greatest(1, horizon - 12)" if open_end else "greatest(1, least(12, horizon - 12))"
    df = add(wide, {"base": base, "wg": growth})
    df = add(df, {"target1": f"last_block * (1 + {rate})"})
    df = add(df, {"target2": f"target1 * (1 + wg * {damping}D)"})
    last = f"get(array({', '.join(f'last12_{i}' for i in range(12))}), CAST((h - 1) % 12 AS INT))"
    df = add(
        df,
        {
            "sum1": f"sum(if(h <= 12, base, NULL)) OVER {PATH}",
            "sum2": f"coalesce(sum(if({second}, base, NULL)) OVER {PATH}, 0D)",
            "shape": f"if(m12 > 0, {last} / m12, {last if open_end else '1D'})",
        },
    )

    def off(total: str, target: str) -> str:
        return f"{total} > 0 AND ({target} = 0 OR try_divide(abs({total} - {target}), {target}) > {TOLERANCE}D)"

    pulled = f"""CASE WHEN h <= 12 AND {off('sum1', 'target1')} THEN target1 / least(12, horizon) * shape
        WHEN {second} AND {off('sum2', 'target2')} THEN target2 / {months2} * shape ELSE base END"""
    df = add(df, {name: f"if({unfit}, {fallback}, greatest({pulled}, 0D))"})
    return df.drop("base", "wg", "target1", "target2", "sum1", "sum2", "shape")


def with_intelligent_growth(wide: DataFrame) -> DataFrame:
    """Growth-calibrated blend of croston, sba and tsb; two complete blocks of history needed."""

    def within(bounds: tuple[float, float]) -> str:
        return f"greatest(least(wg, {bounds[1]}D), {bounds[0]}D)"

    rate = f"""CASE WHEN wg > {GROWING}D THEN {within(CAP_GROW)}
        WHEN wg < {DECLINING}D THEN greatest(wg, {CAP_DECLINE}D) ELSE {within(CAP_STABLE)} END"""
    growth = "if(growth_weight > 0, growth_sum / growth_weight, 0D)"
    return calibrated(
        wide, "intelligent_growth", GROWTH_BASE, growth, rate, YEAR2_DAMPING, "floor(n / 12) < 2", "exp_smoothing"
    )


def with_smart_calibration(wide: DataFrame, method: str, trend: str = "stable") -> DataFrame:
    """Optional calibration of any method, with its own bounds; ``trend`` picks the bounds."""
    growth = "if(growth_age_weight > 0, growth_age_sum / growth_age_weight, 0D)"
    unfit = "floor(n / 12) < 2 OR growth_age_weight = 0"
    return calibrated(
        wide, f"{method}_calibrated", method, growth, SMART_RATES[trend], SMART_DAMPING, unfit, method, open_end=True
    )


def with_ensemble(wide: DataFrame) -> DataFrame:
    """Mean of croston, sba and exponential smoothing."""
    return add(wide, {"ensemble": "(croston + sba + exp_smoothing) / 3"})


def with_advanced_ensemble(
    wide: DataFrame, name: str = "advanced_ensemble", members: tuple[str, ...] | None = None
) -> DataFrame:
    """Weighted mean of the varying members, pulled to their median where it strays from it."""
    members = [m for m in ENSEMBLE_WEIGHTS if m in (members or ENSEMBLE_WEIGHTS)]
    k = len(members)
    df = add(wide, {f"ok_{m}": f"stddev_pop({m}) OVER {PATH} >= 1e-6" for m in members})
    total = " + ".join(f"if(ok_{m}, {ENSEMBLE_WEIGHTS[m]}D * {m}, 0D)" for m in members)
    weight = " + ".join(f"if(ok_{m}, {ENSEMBLE_WEIGHTS[m]}D, 0D)" for m in members)
    df = add(
        df,
        {
            "e_count": " + ".join(f"CAST(ok_{m} AS INT)" for m in members),
            "e_mean": f"try_divide({total}, {weight})",
            "e_sorted": f"sort_array(array({', '.join(f'if(ok_{m}, {m}, NULL)' for m in members)}))",
        },
    )

    def median(column: str) -> str:
        # sort_array puts the missing members first
        low, high = (f"CAST({k} - e_count + floor({x} / 2) AS INT)" for x in ("(e_count - 1)", "e_count"))
        return f"(get({column}, {low}) + get({column}, {high})) / 2"

    df = add(df, {"e_median": median("e_sorted")})
    df = add(df, {"e_off": f"sort_array(array({', '.join(f'if(ok_{m}, abs({m} - e_median), NULL)' for m in members)}))"})
    df = add(df, {"e_mad": median("e_off")})
    df = add(df, {"e_pull": "least(abs(e_mean - e_median) / (3 * e_mad + 1e-6), 1D)"})
    mixed = "greatest(e_mean * (1 - e_pull) + e_median * e_pull, 0D)"
    df = add(df, {name: f"if(e_count = 0, exp_smoothing, {mixed})"})
    scratch = ["e_count", "e_mean", "e_sorted", "e_median", "e_off", "e_mad", "e_pull"]
    return df.drop(*scratch, *[f"ok_{m}" for m in members])


# Methods without fitted members, in reporting order.
CLOSED = tuple(m for m in METHODS if m not in (*FITTED, "lstm", "lightgbm"))


def closed_methods(state: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Every method that stays in the JVM; the ensembles use the closed-form members only."""
    df = with_intelligent_growth(with_closed_forms(steps(levels(state, cfg)), cfg))
    return with_ensemble(with_advanced_ensemble(df, members=CLOSED))


def all_methods(state: DataFrame, cfg: EngineConfig = EngineConfig(), meta=None, tasks: int | None = None) -> DataFrame:
    """Every method at every step. ``meta`` is a function that adds the slot ``lightgbm``; ``tasks`` as in ``by_series``."""
    # Spark does not know that the Python stage keeps rows in their partitions.
    df = by_series(fitted_at_end(levels(state, cfg), cfg.ma_terms, cfg.smoothing_family), tasks)
    df = with_closed_forms(steps(df), cfg)
    df = with_fixed_blend(with_fitted(df, cfg))
    df = with_short_meta(df) if meta is None else meta(df)
    df = with_intelligent_growth(df)
    return with_ensemble(with_advanced_ensemble(df))


def to_long(wide: DataFrame, methods: tuple[str, ...] = METHODS, keys: tuple[str, ...] = ("series_key", "h")) -> DataFrame:
    """Rows ``(keys, method, method_ord, yhat)`` out of the method columns."""
    entries = ", ".join(f"'{m}', {i}, CAST({m} AS DOUBLE)" for i, m in enumerate(methods))
    return wide.selectExpr(*keys, f"stack({len(methods)}, {entries}) AS (method, method_ord, yhat)")
