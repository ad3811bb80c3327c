"""Holdout backtest of every method and the choice of the best one per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.config import METHODS
from tallycast.forecast.combine import to_long, with_advanced_ensemble
from tallycast.functions.columns import add

METRIC_COLUMNS = ("mae", "rmse", "smape", "mae_pct", "bias", "bias_pct", "score_pct", "mase")
# Entries of a forecast that is zero throughout and therefore not scored.
UNSCORED = {"mae": "0D", "rmse": "0D", "smape": "100D", "mae_pct": "100D", "bias": "0D", "mase": "0D"}


def compat_methods(wide: DataFrame) -> DataFrame:
    """The narrower ensembles and the fallback slot that the specification backtests with."""
    df = with_advanced_ensemble(wide, members=("croston", "sba", "weighted_ma"))
    return add(df, {"ensemble": "(exp_smoothing + croston + weighted_ma) / 3", "prophet": "exp_smoothing"})


def backtest_metrics(
    holdout: DataFrame, methods: tuple[str, ...] = METHODS, compat: bool = False
) -> DataFrame:
    """Eight error measures per (series_key, method) from wide forecasts at the holdout origin.

    Grouping by (series, method) keeps the partitioning by series, so nothing is shuffled.
    A held-out step without lines was zero demand.
    """
    wide = add(
        compat_methods(holdout) if compat else holdout,
        {
            "a": "coalesce(try_element_at(actuals, CAST(n + h - 1 AS INT)), 0D)",
            "naive": "naive_sum / (n - 1)",
        },
    )
    long = to_long(wide, methods, ("series_key", "h", "a", "naive"))
    # Rounding noise around zero is not demand; it would count as a full miss in sMAPE.
    long = add(long, {"f": "if(abs(yhat) < 1e-9, 0D, yhat)"})
    long = add(long, {"gap": "abs(a - f)", "middle": "(abs(a) + abs(f)) / 2"})
    aggs = {
        "mae": "avg(gap)",
        "rmse": "sqrt(avg(gap * gap))",
        "smape": "coalesce(avg(if(middle > 0, gap / middle, NULL)), 1D) * 100",
        "mae_pct": "coalesce(avg(if(a > 0, gap / a, NULL)), 0D) * 100",
        "bias": "avg(f - a)",
        "demand": "avg(a)",
        "naive": "max(naive)",
        "empty": "bool_and(f = 0)",
    }
    per = long.groupBy("series_key", "method", "method_ord").agg(*[F.expr(x).alias(k) for k, x in aggs.items()])
    per = add(per, {"bias_pct": "bias / if(demand > 0, demand, 1D) * 100", "mase": "if(naive > 0, mae / naive, 0D)"})
    per = add(per, {"score_pct": "mae_pct + abs(bias_pct)"})
    scores = [f"if(empty, {UNSCORED.get(m, 'NULL')}, {m}) AS {m}" for m in METRIC_COLUMNS]
    return per.selectExpr("series_key", "method", "method_ord", *scores, "if(empty, 'empty', 'ok') AS status")


def best_method(metrics: DataFrame, by: str = "smape", compat: bool = False) -> DataFrame:
    """Method with the least error per series; ties go to the earlier method.

    By MAE an unscored forecast would win with its entry of 0, so it is left out unless
    ``compat`` asks for it. Errors are compared to nine decimals.
    """
    rows = metrics if by == "smape" or compat else metrics.where(F.col("status") == "ok")
    rows = rows.where(F.col(by).isNotNull())
    order = F.struct(F.round(by, 9).alias("error"), "method_ord")
    return rows.groupBy("series_key").agg(
        F.min_by("method", order).alias("method"),
        F.min_by("method_ord", order).alias("method_ord"),
        F.min_by(by, order).alias(by),
    )


# Upper limits of the sMAPE bands.
BANDS = ((10.0, "Excellent"), (20.0, "Good"), (50.0, "Acceptable"))


def smape_band(c: Column) -> Column:
    """Word for an sMAPE."""
    out = None
    for limit, word in BANDS:
        cond = c < limit if limit < 50 else c <= limit
        out = F.when(cond, word) if out is None else out.when(cond, word)
    return out.otherwise("Poor")


def accuracy_ranking(metrics: DataFrame, by: str, k: int = 12, skip: tuple[str, ...] = ()) -> DataFrame:
    """The k methods with the least mean error over all series."""
    rows = metrics.where(~F.col("method").isin(*skip)) if skip else metrics
    means = rows.groupBy("method", "method_ord").agg(F.avg(by).alias(by), F.avg("mae").alias("mean_mae"))
    return means.orderBy(F.col(by).asc_nulls_last(), "method_ord").limit(k).drop("method_ord")


def method_ranking(metrics: DataFrame, by: str = "score_pct", k: int = 12, skip: tuple[str, ...] = ()) -> DataFrame:
    """The k methods with the least error of every series, as ``(series_key, rank, method, by, mae)``.

    Unscored methods (no error) come last; equal errors (to nine decimals) keep the order of methods.
    """
    rows = metrics.where(~F.col("method").isin(*skip)) if skip else metrics
    order = Window.partitionBy("series_key").orderBy(F.round(by, 9).asc_nulls_last(), "method_ord")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("series_key", "rank", "method", *dict.fromkeys((by, "mae")))
