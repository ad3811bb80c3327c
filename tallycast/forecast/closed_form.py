"""Methods that are arithmetic on the series state.

``levels`` turns the state into a few numbers per series; ``EXPRESSIONS`` gives the
forecast of each method at step ``h`` as SQL. No method needs a shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.config import EngineConfig
from tallycast.forecast.changepoints import trend_expression, with_trend_basis
from tallycast.forecast.profile import line_slope, season_at, with_season
from tallycast.forecast.state import ADIDA_LEVELS, HINGES, PROB_KEEP, SEASON, SIZE_ALPHA, SIZE_KEEP, WMA_WINDOW
from tallycast.functions.columns import add


def _clip(x: str, lo: str, hi: str) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def levels(state: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add the per-series levels, trends and coefficients of the closed-form methods."""
    if cfg.change_points:
        state = with_trend_basis(state).drop("trend_branch")
    keep = f"pow({SIZE_KEEP}D, updates)"
    df = add(
        with_season(state),
        {
            "mean_v": "sum_all / n",
            "size": f"if(nnz > 0, {keep} * sum_pos / nnz + size_sum, 0D)",
            "gap": f"if(nnz > 0, {keep} * n / nnz + gap_sum, 1D)",
            "prob": f"pow({PROB_KEEP}D, n - 1) * nnz / n + prob_sum",
            "trend3": "if(n >= 6, (last3 - prev3) / 9, 0D)",
            "win": WMA_WINDOW,
            "wma_ratio": f"exp(3D / ({WMA_WINDOW} - 1))",
        },
    )
    df = add(
        df,
        {
            "rate": "size / greatest(1D, gap)",
            "es_trend": _clip("trend3", "es_level * -0.15D", "es_level * 0.15D"),
            # the window's weights are a geometric series from exp(-3) to 1
            "wma_level": "wma_sum * (wma_ratio - 1) / (pow(wma_ratio, win) - 1) * exp(3D)",
            "wma_drift": "if(n >= 2 * win, (wma_recent - wma_earlier) / (win * win), 0D)",
            "adida_level": _adida_level(),
        },
    )
    df = add(df, {"wma_trend": _clip("wma_drift", "wma_level * -0.1D", "wma_level * 0.15D")})
    # Narrow rows keep the later stages cheap to plan and to sort.
    used = [f"phase_{kind}{i}" for kind in ("pos", "nnz", "all") for i in range(SEASON)]
    used += [f"adida{level}" for level in ADIDA_LEVELS]
    used += [f"hinge{j}" for j in range(HINGES)]
    used += ["size_sum", "gap_sum", "prob_sum", "wma_sum", "wma_recent", "wma_earlier", "wma_ratio", "wma_drift"]
    used += ["log_sum", "log_x_sum", "first12", "prev3", "mean_pos", "updates", "gap", "win", "var_pos"]
    return _log_line(_straight_line(df)).drop(*used)


def _adida_level() -> str:
    """Mean over aggregation levels of the mean of the last (up to 3) buckets per period."""
    totals, used = [], []
    for level in ADIDA_LEVELS:
        applies = f"floor(n / {level}) >= 2" + ("" if level <= 2 else " AND n >= 12")
        totals.append(f"if({applies}, adida{level} / least(floor(n / {level}), 3) / {level}, 0D)")
        used.append(f"CAST({applies} AS INT)")
    mean = f"try_divide({' + '.join(totals)}, {' + '.join(used)})"
    return f"if(n < 3, mean_v, greatest({mean}, 0D))"


def _log_line(df: DataFrame) -> DataFrame:
    """Weighted line through ln(v + 1) against the distance k from the last step.

    The weights are q^k with q = exp(-2 / (n-1)), so the sums of w, w*k and w*k^2 are
    geometric and depend on n only.
    """
    df = add(df, {"lq": "exp(-2D / greatest(n - 1, 1))"})
    df = add(df, {"lp": "pow(lq, n - 1)", "lqn": "pow(lq, n)"})
    df = add(
        df,
        {
            "ls0": "(1 - lqn) / (1 - lq)",
            "ls1": "lq * (1 - n * lp + (n - 1) * lqn) / pow(1 - lq, 2)",
            "ls2": "lq * (1 + lq - 1D * n * n * lp + (2D * n * n - 2 * n - 1) * lqn - 1D * (n - 1) * (n - 1) * lqn * lq)"
            " / pow(1 - lq, 3)",
        },
    )
    slope = "if(n >= 3, (ls0 * log_x_sum - ls1 * log_sum) / (ls0 * ls2 - ls1 * ls1), 0D)"
    df = add(df, {"log_slope": slope})
    return add(df, {"log_level": "(log_sum - log_slope * ls1) / ls0"}).drop("lq", "lp", "lqn", "ls0", "ls1", "ls2")


def _straight_line(df: DataFrame) -> DataFrame:
    """Trend line and the mean residual per phase of the trend-and-season method."""
    change = "try_divide(m12 - first12 / least(n, 12), first12 / least(n, 12) + 1)"
    slope = line_slope("n", "0", "sum_all", "tv")
    df = add(df, {"line_slope": f"if({change} < -0.3D, 0D, {slope})"})
    df = add(df, {"line_start": "mean_v - line_slope * (n - 1) / 2"})
    residuals = []
    for i in range(SEASON):
        count = f"(floor((n - 1 - {i}) / {SEASON}) + 1)"
        steps = f"({count} * {i} + {SEASON // 2} * {count} * ({count} - 1))"
        rest = f"(phase_all{i} - line_slope * {steps}) / {count} - line_start"
        residuals.append(f"if(n >= {2 * SEASON}, {rest}, 0D)")
    return add(df, {"residual": f"array({', '.join(residuals)})"})


def _expressions(align_phase: bool, change_points: bool = False) -> dict[str, str]:
    phase = f"CAST(({'n + ' if align_phase else ''}h - 1) % {SEASON} AS INT)"
    season = season_at(phase)
    es = "greatest(es_level + if(n >= 6, es_trend * h, 0D), 0D)"
    grown = "least(exp(log_level - log_slope * h) - 1, m12 * (1.5D + exp(vol12 * -0.5D)))"
    damp = "exp(-0.05D * (h - 1))"
    return {
        "croston": "if(nnz > 0, greatest(rate + trend3 * h * 0.3D, 0D), 0D)",
        "sba": f"if(nnz > 0, greatest(rate * {1 - SIZE_ALPHA / 2}D * {season}, 0D), 0D)",
        "tsb": "if(nnz > 0, greatest(prob * size * if(n >= 12 AND vol12 > 0.5D, 0.9D, 1D), 0D), 0D)",
        "adida": "adida_level",
        "exp_smoothing": es,
        "weighted_ma": f"greatest((wma_level + wma_trend * h) * {season}, 0D)",
        "ma_benchmark": "if(n < 3, mean_v, greatest(last3 / 3, 0D))",
        "exponential_trend": f"CASE WHEN n < 6 THEN mean_v WHEN min_v <= -1 THEN {es}"
        f" ELSE greatest({grown} * {damp} + mean_v * (1 - {damp}), 0D) END",
        # slot of the trend-and-season method
        "prophet": trend_expression() if change_points else "greatest(line_start + line_slope * (n + h - 1)"
        f" + get(residual, CAST((n + h - 1) % {SEASON} AS INT)), 0D)",
    }


METHODS_CLOSED = tuple(_expressions(False))
GROWTH_BASE = "0.5D * croston + 0.3D * sba + 0.2D * tsb"


def expression(method: str, cfg: EngineConfig = EngineConfig()) -> str:
    """SQL of one closed-form method at step ``h``."""
    return _expressions(cfg.align_phase, cfg.change_points)[method]


def with_closed_forms(wide: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add all closed-form methods to rows of steps."""
    return add(wide, _expressions(cfg.align_phase, cfg.change_points))


def steps(df: DataFrame) -> DataFrame:
    """One row per forecast step ``h`` = 1 .. horizon."""
    return df.withColumn("h", F.explode(F.sequence(F.lit(1), F.col("horizon"))))


def forecast(state: DataFrame, method: str, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """One closed-form method as ``(series_key, method, h, yhat)``."""
    rows = steps(levels(state, cfg))
    return rows.selectExpr("series_key", f"'{method}' AS method", "h", f"{expression(method, cfg)} AS yhat")
