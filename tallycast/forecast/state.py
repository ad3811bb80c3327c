"""One row of sufficient statistics per (series, origin).

A forecast made at ``origin`` sees the steps t < origin. Smoothing with a constant
factor a is a weighted sum: after J updates the state is
``(1-a)^J * start + sum_j a * (1-a)^(J-j) * x_j``. So every closed-form method needs
only sums over the *sparse* series (steps without demand add nothing), and the whole
set of methods is fed by one shuffle on the series key: windows, then one aggregate.
Columns that a query does not use are pruned from the windows and the aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.config import EngineConfig
from tallycast.functions.columns import add

SEASON = 12
# Smoothing factors of demand size and interval, and of demand probability.
SIZE_ALPHA = 0.25
PROB_ALPHA = 0.15
ADIDA_LEVELS = (1, 2, 3, 4)
ROLLING_START, ROLLING_STEPS = 24, 3
HINGES = 6  # change points a trend may have


def hinge_at(j: int) -> float:
    """Place of a change point as a share of the history: evenly over its first 80 %."""
    return 0.8 * (j + 1) / HINGES


def test_size(n: Column) -> Column:
    """Length of the holdout tail."""
    return F.greatest(F.lit(3), F.floor(n / 5).cast("int"))


def at_origins(indexed: DataFrame, kind: str, horizon: int, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add ``origin`` and ``horizon``: full history or holdout."""
    n = F.col("n")
    full = F.struct(n.cast("int").alias("origin"), F.lit(horizon).alias("horizon"), F.lit(False).alias("holdout"))
    test = test_size(n)
    back = F.struct((n - test).cast("int").alias("origin"), test.alias("horizon"), F.lit(True).alias("holdout"))
    enough = n >= cfg.backtest_min_periods
    if kind == "full":
        return indexed.withColumn("at", full).select("*", "at.*").drop("at")
    if kind == "holdout":
        return indexed.where(enough).withColumn("at", back).select("*", "at.*").drop("at")
    raise ValueError(f"unknown kind of origins {kind!r}")


SIZE_KEEP, PROB_KEEP = 1 - SIZE_ALPHA, 1 - PROB_ALPHA
WMA_WINDOW = "greatest(3, least(12, floor(n / 4)))"

# Windows over the steps of a (series, origin); the numbered stages build on each other.
_ALL = "PARTITION BY series_key, origin"
_BY_T = f"{_ALL} ORDER BY t"
_BY_BLOCK = f"{_ALL} ORDER BY block"

_STEP_COLUMNS = {
    "prev_pos": f"coalesce(max(if(v > 0, t, NULL)) OVER ({_BY_T} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)",
    "j": f"count(if(v > 0 AND t >= 1, 1, NULL)) OVER ({_BY_T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "prev_t": f"lag(t) OVER ({_BY_T})",
    "prev_v": f"lag(v) OVER ({_BY_T})",
    "next_t": f"lead(t) OVER ({_BY_T})",
    "updates": f"count(if(v > 0 AND t >= 1, 1, NULL)) OVER ({_ALL})",
    "span": "least(n, 12)",
    "m12": f"coalesce(sum(if(t >= n - 12, v, NULL)) OVER ({_ALL}), 0D) / least(n, 12)",
    "c12": f"count(if(t >= n - 12, v, NULL)) OVER ({_ALL})",
    "block": f"floor(t / {SEASON})",
    "blocks": f"floor(n / {SEASON})",
}
# Steps without a row are zeros: each adds m12 squared to the spread around the mean.
_SPREAD_COLUMNS = {
    "d12": f"coalesce(sum(if(t >= n - 12, (v - m12) * (v - m12), NULL)) OVER ({_ALL}), 0D) + (span - c12) * m12 * m12"
}
_VOLATILITY_COLUMNS = {"vol12": "coalesce(try_divide(sqrt(d12 / span), m12 + 1), 0D)"}
_ALPHA_COLUMNS = {"alpha": "if(n >= 12, 0.3D + 0.2D * exp(-vol12), 0.35D)"}
# Blocks of 12 steps from the start: a block and the next one are range frames on its number.
_BLOCK_COLUMNS = {
    "total": f"coalesce(sum(v) OVER ({_BY_BLOCK} RANGE BETWEEN CURRENT ROW AND CURRENT ROW), 0D)",
    "next_total": f"coalesce(sum(v) OVER ({_BY_BLOCK} RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), 0D)",
}
_GROWS_COLUMNS = {
    "grows": f"(prev_t IS NULL OR floor(prev_t / {SEASON}) < block) AND block + 1 < blocks AND total > 0"
}
_GROWTH_COLUMNS = {
    "growth": "if(grows, (next_total - total) / total, NULL)",
    "g_rank": f"count(if(grows, 1, NULL)) OVER ({_BY_BLOCK} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
}
_WEIGHT_COLUMNS = {
    "back": "n - 1 - t",
    "size_w": f"{SIZE_ALPHA}D * pow({SIZE_KEEP}D, updates - j)",
    "es_w": "if(t = 0, pow(1 - alpha, n - 1), alpha * pow(1 - alpha, n - 1 - t))",
    "win": WMA_WINDOW,
    "trend_w": "exp(-2D * (n - 1 - t) / greatest(n - 1, 1))",
}
_STAGES = (
    _STEP_COLUMNS, _SPREAD_COLUMNS, _VOLATILITY_COLUMNS, _ALPHA_COLUMNS,
    _BLOCK_COLUMNS, _GROWS_COLUMNS, _GROWTH_COLUMNS, _WEIGHT_COLUMNS,
)


def _sum(x: str, where: str | None = None) -> str:
    return f"coalesce(sum({x if where is None else f'if({where}, {x}, NULL)'}), 0D)"


def _aggregates() -> dict[str, str]:
    """Name -> aggregate over the steps of a (series, origin)."""
    aggs = {
        "n": "max(n)",
        "horizon": "max(horizon)",
        "holdout": "bool_or(holdout)",
        "nnz": "count(if(v > 0, 1, NULL))",
        "sum_pos": _sum("v", "v > 0"),
        "sum_all": _sum("v"),
        "var_pos": "coalesce(var_pop(if(v > 0, v, NULL)), 0D)",
        "first_pos": "min(if(v > 0, t, NULL))",
        "last_pos": "max(if(v > 0, t, NULL))",
        "min_v": "min(v)",
        "last_v": _sum("v", "t = n - 1"),
        "last6": _sum("v", "t >= n - 6"),
        "updates": "max(updates)",
        "size_sum": _sum("size_w * v", "v > 0 AND t >= 1"),
        "gap_sum": _sum("size_w * (t - prev_pos)", "v > 0 AND t >= 1"),
        "prob_sum": _sum(f"{PROB_ALPHA}D * pow({PROB_KEEP}D, back)", "v > 0 AND t >= 1"),
        "es_level": _sum("es_w * v"),
        "m12": "max(m12)",
        "vol12": "max(vol12)",
        "last3": _sum("v", "t >= n - 3"),
        "prev3": _sum("v", "t >= n - 6 AND t < n - 3"),
        "wma_sum": _sum("exp(-3D + 3D * (t - (n - win)) / (win - 1)) * v", "t >= n - win"),
        "wma_recent": _sum("v", "t >= n - win"),
        "wma_earlier": _sum("v", "t >= n - 2 * win AND t < n - win"),
        "log_sum": _sum("trend_w * ln(v + 1)"),
        "log_x_sum": _sum("trend_w * ln(v + 1) * back"),
        "tv": _sum("t * v"),
        "half_v": _sum("v", "t < floor(n / 2)"),
        "half_tv": _sum("t * v", "t < floor(n / 2)"),
        "recent_sum": _sum("v", "t >= n - 12"),
        "earlier_sum": _sum("v", "t < n - 12 AND (t >= n - 24 OR n < 24)"),
        "first12": _sum("v", "t < 12"),
        "last_block": _sum("v", "block = blocks - 1"),
        "growth_sum": _sum("growth * g_rank"),
        "growth_weight": "coalesce(sum(if(grows, g_rank, NULL)), 0)",
        "growth_age_sum": _sum("growth * (block + 1)"),
        "growth_age_weight": "coalesce(sum(if(grows, block + 1, NULL)), 0)",
        # absolute change into each step with a row, and out of it into an empty step
        "naive_sum": _sum(
            "if(t >= 1, abs(v - if(prev_t = t - 1, prev_v, 0D)), 0D)"
            " + if(t + 1 <= n - 1 AND (next_t IS NULL OR next_t > t + 1), abs(v), 0D)"
        ),
        "actuals": "map_from_entries(collect_list(if(t >= n AND t < n + horizon, struct(t, value), NULL)))",
        "hist_t": "collect_list(if(t < n, t, NULL))",
        "hist_v": "collect_list(v)",
        "positives": "collect_list(if(v > 0, struct(t, v), NULL))",
    }
    for level in ADIDA_LEVELS:
        ends = f"floor(n / {level})"
        aggs[f"adida{level}"] = _sum("v", f"t >= greatest({ends} - 3, 0) * {level} AND t < {ends} * {level}")
    for j in range(HINGES):
        aggs[f"hinge{j}"] = _sum(f"greatest(t - {hinge_at(j)!r}D * (n - 1), 0D) * v")
    for i in range(SEASON):
        aggs[f"last12_{i}"] = _sum("v", f"t = n - {SEASON - i}")
        aggs[f"phase_pos{i}"] = _sum("v", f"t % {SEASON} = {i} AND v > 0")
        aggs[f"phase_nnz{i}"] = f"count(if(t % {SEASON} = {i} AND v > 0, 1, NULL))"
        aggs[f"phase_all{i}"] = _sum("v", f"t % {SEASON} = {i}")
    return aggs


def series_state(
    indexed: DataFrame, kind: str = "full", horizon: int = 12, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """Statistics per (series_key, origin) of an indexed series (sparse or dense).

    In the aggregates ``n`` is the origin, ``v`` the value of a step before it.
    """
    dated = ["period_start"] if "period_start" in indexed.columns else []
    df = at_origins(indexed.select("series_key", "t", "n", "value", *dated), kind, horizon, cfg)
    df = df.selectExpr(
        "series_key", "origin", "horizon", "holdout", "t", "value", *dated,
        "origin AS n", "if(t < origin, value, NULL) AS v",
    )
    for stage in _STAGES:
        df = add(df, stage)
    aggs = _aggregates()
    if dated:
        aggs["first_start"] = "min(period_start)"
    return df.groupBy("series_key", "origin").agg(*[F.expr(text).alias(name) for name, text in aggs.items()])
