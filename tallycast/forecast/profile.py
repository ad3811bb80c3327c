"""Demand profile, growth profile and seasonal index of every series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.config import EngineConfig
from tallycast.forecast.state import SEASON, series_state
from tallycast.functions.columns import add


def demand_profile(indexed: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Share of periods with demand, average demand interval, CV squared, and the flags they give."""
    out = series_state(indexed, cfg=cfg).selectExpr(
        "series_key",
        "n",
        "nnz / n * 100 AS pct_non_zero",
        "if(nnz > 1, (last_pos - first_pos) / (nnz - 1), CAST(n AS DOUBLE)) AS adi",
        "if(nnz > 1, var_pos * nnz * nnz / (sum_pos * sum_pos), 0D) AS cv2",
    )
    rare = f"pct_non_zero < {cfg.intermittent_threshold_pct} OR adi > {cfg.adi_threshold}"
    return add(out, {"is_intermittent": rare, "is_volatile": f"cv2 > {cfg.volatility_cv2}"})


def line_slope(count: str, first: str, s_y: str, s_ty: str) -> str:
    """Least-squares slope of y on the steps first, first+1, ... ; s_ty is the sum of t*y."""
    mean_t = f"({first} + ({count} - 1) / 2D)"
    spread = f"({count} * ({count} * {count} - 1) / 12D)"
    return f"coalesce(try_divide({s_ty} - {mean_t} * {s_y}, {spread}), 0D)"


def with_growth(s: DataFrame) -> DataFrame:
    """Add year-over-year growth, slope, trend direction and the growth flag to a state."""
    yoy = "CASE WHEN earlier_sum > 0 THEN (recent_sum - earlier_sum) / earlier_sum * 100 WHEN recent_sum = 0 THEN 0D ELSE 100D END"
    half, rest = "floor(n / 2)", "(n - floor(n / 2))"
    df = add(
        s,
        {
            "trend_slope": f"if(n >= 12, {line_slope('n', '0', 'sum_all', 'tv')}, 0D)",
            "slope_1": line_slope(half, "0", "half_v", "half_tv"),
            "slope_2": line_slope(rest, half, "(sum_all - half_v)", "(tv - half_tv)"),
            "yoy_growth_pct": f"if(n >= 12, {yoy}, 0D)",
            "mean_v": "sum_all / n",
        },
    )
    direction = """CASE WHEN n < 12 THEN 'insufficient_data'
        WHEN n >= 24 AND slope_2 > slope_1 * 1.5D THEN 'accelerating'
        WHEN n >= 24 AND slope_2 < slope_1 * 0.5D AND trend_slope > mean_v * 0.01D THEN 'decelerating'
        WHEN trend_slope > mean_v * 0.01D THEN 'growing'
        WHEN trend_slope < -mean_v * 0.01D THEN 'declining' ELSE 'stable' END"""
    df = add(df, {"trend_direction": direction}).drop("slope_1", "slope_2")
    return add(df, {"has_growth": "yoy_growth_pct > 5 AND trend_direction IN ('growing', 'accelerating')"})


def growth_profile(indexed: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Growth columns of every series."""
    return with_growth(series_state(indexed, cfg=cfg)).selectExpr(
        "series_key",
        "has_growth",
        "yoy_growth_pct",
        "trend_slope",
        "trend_direction",
        "if(n < 12, sum_all, recent_sum) AS recent_sum",
        "if(n < 12, 0D, earlier_sum) AS earlier_sum",
    )


def with_season(s: DataFrame) -> DataFrame:
    """Add ``raw_index``, the 12 phase indices, and the mean of their smoothed form.

    Smoothing is a mean of three neighbours with zeros beyond both ends, so inner phases
    enter the mean of the smoothed indices three times and the two ends twice.
    """
    df = add(s, {"mean_pos": "if(nnz > 0, sum_pos / nnz, 1D)"})
    raw = [f"if(phase_nnz{i} > 0, phase_pos{i} / phase_nnz{i} / mean_pos, 1D)" for i in range(SEASON)]
    mean = f"(3 * ({' + '.join(raw)}) - {raw[0]} - {raw[-1]}) / {3 * SEASON}"
    return add(df, {"raw_index": f"array({', '.join(raw)})", "smooth_mean": mean})


def season_at(phase: str) -> str:
    """Smoothed and normalised index of a phase; 1 below two cycles of history."""
    near = f"(coalesce(get(raw_index, {phase} - 1), 0D) + get(raw_index, {phase}) + coalesce(get(raw_index, {phase} + 1), 0D))"
    return f"if(n >= {2 * SEASON}, {near} / 3 / smooth_mean, 1D)"


def seasonal_index(indexed: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Seasonal index rows ``(series_key, phase, idx)``."""
    s = with_season(series_state(indexed, cfg=cfg)).select("series_key", "n", "raw_index", "smooth_mean")
    s = s.withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(SEASON - 1))))
    return s.selectExpr("series_key", "phase", f"{season_at('phase')} AS idx")
