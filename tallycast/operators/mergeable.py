"""Views kept as mergeable states: sums as decimals and distinct items as sketches, by dimensions and month.

States of two sets of lines add up to the state of both, so views roll up over months and dimensions without the lines,
and lines that arrive later cost a pass over themselves only. Exact distinct counts (``rollups``) stay the default; they
cannot be merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.operators.rollups import VIEW_MEASURES

#: log2 of the buckets of a sketch; three standard errors of an estimate that went through unions are ``items_bound``.
SKETCH_BITS = 12
MONTH = "period_month"
BATCH = "batch"


def items_bound(bits: int = SKETCH_BITS) -> float:
    """Largest relative error of a number of items, but for about one estimate in 400."""
    return 3 * 1.04 / 2 ** (bits / 2)


def as_read(c: Column) -> Column:
    """A measure as a decimal, read to as many places as ``exact_sum`` reads, so that states give the same sums."""
    size = F.abs(c)
    places = F.when(size < 1e3, F.round(c, 12)).when(size < 1e6, F.round(c, 9)).otherwise(F.round(c, 6))
    return places.cast("decimal(28,12)")


def states(lines: DataFrame, dims: tuple[str, ...], measures: tuple[str, ...] = VIEW_MEASURES, bits: int = SKETCH_BITS) -> DataFrame:
    """State rows ``(dims, period_month, n_lines, measures, items)`` of a set of lines.

    Sums are DECIMAL with twelve places (values are read as by ``exact_sum``), which are the same in any order and stay so when merged; a value beyond 10^16
    raises. ``items`` is a sketch of ``sku``, of about 2^bits bytes at most and built on the map side, so a member that owns a
    third of the lines is one row a task. Null items and null measures count nothing, as in SQL.
    """
    sums = [F.coalesce(F.sum(as_read(F.col(m))), F.lit(0)).cast("decimal(38,12)").alias(m) for m in measures]
    return lines.groupBy(*dims, MONTH).agg(F.count(F.lit(1)).alias("n_lines"), *sums, F.hll_sketch_agg("sku", bits).alias("items"))


def merged(rows: DataFrame, keys: tuple[str, ...], measures: tuple[str, ...] = VIEW_MEASURES) -> DataFrame:
    """States by fewer or the same keys: any of the dimensions, the month, or columns derived from them."""
    sums = [F.sum(m).cast("decimal(38,12)").alias(m) for m in measures]
    return rows.groupBy(*keys).agg(F.sum("n_lines").alias("n_lines"), *sums, F.hll_union_agg("items").alias("items"))


def shown(rows: DataFrame, measures: tuple[str, ...] = VIEW_MEASURES) -> DataFrame:
    """States as numbers: sums as doubles, and ``items`` as an estimate within ``items_bound``."""
    rest = [c for c in rows.columns if c not in (*measures, "items")]
    sums = [F.col(m).cast("double").alias(m) for m in measures]
    return rows.select(*rest, *sums, F.hll_sketch_estimate("items").alias("items"))


def add_batch(
    lines: DataFrame, path: str, batch: str, dims: tuple[str, ...], measures: tuple[str, ...] = VIEW_MEASURES, bits: int = SKETCH_BITS
) -> None:
    """Write the states of a batch of lines into the table at ``path``, in folders of their months.

    Nothing written before is read or rewritten, whatever months late lines fall in. A batch that is written again (after a
    failure, say) replaces itself, so it is never counted twice; months that it no longer has keep their former states.
    """
    rows = states(lines, dims, measures, bits).withColumn(BATCH, F.lit(batch))
    # One task a month: states are small, and files in a folder few.
    rows.repartition(MONTH).write.partitionBy(MONTH, BATCH).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_states(spark: SparkSession, path: str, dims: tuple[str, ...], measures: tuple[str, ...] = VIEW_MEASURES) -> DataFrame:
    """All batches merged by ``(dims, period_month)``. Filters on the month reach the folders."""
    rows = spark.read.parquet(path).withColumn(MONTH, F.col(MONTH).cast("date"))
    return merged(rows, (*dims, MONTH), measures)
