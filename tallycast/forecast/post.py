"""Post-processing of forecasts in wide form: flatness repair, then growth scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.config import METHODS, EngineConfig
from tallycast.forecast.combine import PATH
from tallycast.forecast.profile import with_growth
from tallycast.functions.columns import add, hashed_normal

# Flatness limit, least slope, noise share, scaling limits.
FLAT_CV, LEAST_SLOPE, NOISE_SHARE = 0.01, 0.001, 0.02
SCALE_BELOW, SCALE_TO, SCALE_CAP = 0.7, 0.88, 1.5


def flat(values: str) -> str:
    """Less than two steps, or hardly any spread; a mean of zero or below counts as flat too."""
    mean, sd = f"avg({values}) OVER {PATH}", f"stddev_pop({values}) OVER {PATH}"
    return f"horizon < 2 OR coalesce(try_divide({sd}, {mean}), 0D) < {FLAT_CV}D"


def unflatten(wide: DataFrame, methods: tuple[str, ...] = METHODS, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Give flat paths the slope of their history; with ``cfg.noise`` the rest gets seeded noise."""
    tilts = f"n >= 3 AND abs(trend_slope) > {LEAST_SLOPE}D * mean_v"
    df = add(wide, {"tilt": f"if({tilts}, trend_slope * h, 0D)"})
    df = add(
        df,
        {f"flat_{m}": flat(m) for m in methods} | {f"stays_{m}": flat(f"({m} + tilt)") for m in methods},
    )
    if cfg.noise:
        keys = (F.col("series_key"), F.col("h"))
        df = df.withColumns({f"noise_{m}": hashed_normal(cfg.seed, F.lit(m), *keys) for m in methods})
    fixed = {}
    for m in methods:
        still = f"{m} + noise_{m} * {NOISE_SHARE}D * mean_v" if cfg.noise else m
        fixed[m] = f"if(flat_{m}, if(stays_{m}, {still}, {m} + tilt), {m})"
    scratch = [f"{p}_{m}" for m in methods for p in ("flat", "stays", "noise")]
    return add(df, fixed).drop("tilt", *scratch)


def growth_scaling(wide: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Raise paths of growing series that fall far below the last 12 periods."""
    df = add(wide, {f"sum_{m}": f"sum({m}) OVER {PATH}" for m in methods})
    eligible = "has_growth AND trend_direction NOT IN ('declining', 'decelerating')"
    scaled = {
        m: f"if({eligible} AND sum_{m} > 0 AND sum_{m} < {SCALE_BELOW}D * recent_sum,"
        f" {m} * least({SCALE_TO}D * recent_sum / sum_{m}, {SCALE_CAP}D), {m})"
        for m in methods
    }
    return add(df, scaled).drop(*[f"sum_{m}" for m in methods])


def finished(wide: DataFrame, methods: tuple[str, ...] = METHODS, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Flatness repair, growth profile, growth scaling, in this order."""
    return growth_scaling(unflatten(with_growth(wide), methods, cfg), methods)
