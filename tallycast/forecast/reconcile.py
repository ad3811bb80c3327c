"""Forecasts of a tree of levels that add up: total > cell > item, or any other chain of dimensions.

Every node is forecast on its own, and the forecasts of all nodes are then moved as little as possible (weighted least
squares, each node by its variance) until every parent is the sum of its children. On a tree this needs no matrix: what
a node's subtree says about the node is a mean weighted by precision, passed up by one aggregate a level, and the gap
that is left is dealt out by variance, passed down by one join a level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.config import EngineConfig
from tallycast.forecast import closed_form
from tallycast.forecast.state import series_state
from tallycast.functions.columns import add, exact_sum
from tallycast.functions.periods import ordinal, period_start
from tallycast.functions.session import cut_lineage
from tallycast.operators.series import index_series

#: Variance of a node's forecast: in proportion to its level, or the square of its mean absolute one-step change.
VARIANCES = {"level": "abs(sum_all) / n", "naive": "pow(naive_sum / greatest(n - 1, 1), 2)"}
LEAST_VARIANCE = 1e-6


def node_series(lines: DataFrame, dims: tuple[str, ...], metric: str = "qty", freq: str = "M") -> DataFrame:
    """Sparse series of every node of the tree that ``dims`` span, as ``(depth, series_key, parent, period_start, value)``.

    ``series_key`` is the path from the total as a JSON array (``[]`` is the total, a null member is a member), ``parent``
    the path without its last part. Lines are summed to (leaf, period) on the map side first; only those sums are counted
    for all levels, so neither the total nor a large member is a large group.
    """
    period = period_start(F.col("booked_date"), freq).alias("period_start")
    leaves = lines.groupBy(*dims, period).agg(exact_sum(metric).alias("value"))
    path = F.array(*[F.col(d).cast("string") for d in dims])
    rows = leaves.select(path.alias("path"), "period_start", "value", F.explode(F.sequence(F.lit(0), F.lit(len(dims)))).alias("depth"))
    rows = rows.select("depth", "period_start", "value", F.slice("path", F.lit(1), F.col("depth")).alias("path"))
    key = F.to_json("path", {"ignoreNullFields": "false"})
    parent = F.when(F.col("depth") > 0, F.to_json(F.slice("path", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0)))))
    rows = rows.select("depth", key.alias("series_key"), parent.alias("parent"), "period_start", "value")
    return rows.groupBy("depth", "series_key", "parent", "period_start").agg(exact_sum("value").alias("value"))


def base_forecasts(
    nodes: DataFrame, method: str, horizon: int = 12, freq: str = "M", variance: str = "level", cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """Forecast of every node by a closed-form method, as ``(depth, series_key, parent, h, yhat, variance)``.

    All histories end at the last period of the whole tree, so step ``h`` is the same period everywhere; periods without
    lines before it are zeros. No node is left out for its length, else its parent's demand would go to its siblings.
    """
    end = nodes.agg(F.max(ordinal(F.col("period_start"), freq))).scalar()
    indexed = index_series(nodes, freq)
    indexed = indexed.withColumn("n", (end - ordinal(F.col("period_start"), freq) + F.col("t") + 1).cast("int"))
    # A node's place in the tree follows from its key, so it need not travel through the aggregates of the series.
    state = series_state(indexed, "full", horizon, cfg)
    rows = closed_form.steps(closed_form.levels(add(state, {"variance": f"greatest({VARIANCES[variance]}, {LEAST_VARIANCE}D)"}), cfg))
    path = "from_json(series_key, 'array<string>')"
    return rows.selectExpr(
        f"size({path}) AS depth", "series_key",
        f"if(size({path}) > 0, to_json(slice({path}, 1, greatest(size({path}) - 1, 0))), NULL) AS parent",
        "h", f"{closed_form.expression(method, cfg)} AS yhat", "variance",
    )


def reconciled(base: DataFrame, depth: int) -> DataFrame:
    """Add ``value``: the forecasts moved by weighted least squares so that each parent is the sum of its children.

    ``base`` has a row ``(depth, series_key, parent, h, yhat, variance)`` for each node and step, variances above zero, and
    ``depth`` is the depth of its leaves. A node without children, at whatever depth, is a leaf. A parent without a row of
    its own constrains nothing: its children are tops of trees of their own. Values may be below zero where a parent's
    forecast is far below its children's; clipping them would break the sums. Nulls in ``yhat`` or ``variance`` are not
    defined and raise.
    """
    sound = F.col("yhat").isNotNull() & F.coalesce(F.col("variance") > 0, F.lit(False))
    checked = F.when(sound, F.col("yhat")).otherwise(F.raise_error(F.lit("forecasts and positive variances needed")))
    base = base.withColumn("yhat", checked)
    passed, below = [], None
    for d in range(depth, -1, -1):
        rows = base.where(F.col("depth") == d)
        if below is None:
            rows = add(rows, {"kids": "CAST(NULL AS DOUBLE)", "kids_var": "CAST(NULL AS DOUBLE)"})
        else:
            sums = below.groupBy(F.col("parent").alias("series_key"), "h").agg(F.sum("up").alias("kids"), F.sum("up_var").alias("kids_var"))
            rows = rows.join(sums, ["series_key", "h"], "left")
        # what the node and its subtree say together, and how sure they are
        below = add(
            rows,
            {
                "up": "if(kids_var IS NULL, yhat, (yhat * kids_var + kids * variance) / (variance + kids_var))",
                "up_var": "if(kids_var IS NULL, variance, variance * kids_var / (variance + kids_var))",
            },
        )
        passed.append(below)
    done, above = [], None
    for rows in reversed(passed):
        if above is None:
            rows = rows.withColumn("value", F.col("up"))
        else:
            gaps = above.where("kids IS NOT NULL").selectExpr("series_key AS parent", "h", "(value - kids) / kids_var AS gap")
            rows = add(rows.join(gaps, ["parent", "h"], "left"), {"value": "up + coalesce(gap * up_var, 0D)"})
        above = rows
        done.append(rows.select("depth", "series_key", "parent", "h", "yhat", "value"))
    return reduce(DataFrame.unionByName, done)


def reconciled_forecasts(
    lines: DataFrame, dims: tuple[str, ...], method: str, metric: str = "qty", freq: str = "M",
    horizon: int = 12, variance: str = "level", cfg: EngineConfig = EngineConfig(),
) -> DataFrame:
    """Forecasts of all nodes of a tree of dimensions, and the same made to add up.

    The base forecasts are read by every level of both passes, so their lineage is cut once.
    """
    base = base_forecasts(node_series(lines, dims, metric, freq), method, horizon, freq, variance, cfg)
    return reconciled(cut_lineage(base.sparkSession, base), len(dims))
