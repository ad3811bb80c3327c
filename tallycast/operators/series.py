"""Demand series: aggregate, index, densify, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallycast.config import EngineConfig
from tallycast.functions.columns import exact_parts, exact_sum, exact_total
from tallycast.functions.periods import ordinal, period_start, shift
from tallycast.functions.session import cut_lineage, input_bytes

METRICS = ("qty", "usd_amount", "weight_tons")
_LEVEL_COLUMN = {"item": "sku", "system": "system", "cell": "cell"}
_LEVEL_CATEGORY = {"prime": "Prime", "standard": "Standard"}
LEVELS = (*_LEVEL_COLUMN, *_LEVEL_CATEGORY)


def level_columns(level: str) -> list[str]:
    """Columns of the fact a level needs."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")
    return [_LEVEL_COLUMN[level]] if level in _LEVEL_COLUMN else ["item_category"]


def build_series(lines: DataFrame, level: str, metric: str, freq: str = "M") -> DataFrame:
    """Sparse series ``(level, series_key, period_start, value)`` of every member of a level.

    The lines are shuffled only after they were summed to (member, period) on the map
    side, so a member that owns a large part of the lines is a few rows per task. Large inputs are spread first (see
    ``spread_sums``).
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    column = level_columns(level)[0]
    if level in _LEVEL_CATEGORY:
        lines = lines.where(F.col("item_category") == _LEVEL_CATEGORY[level])
    period = period_start(F.col("booked_date"), freq).alias("period_start")
    if large_input(lines):
        rows = spread_sums(lines, column, period, metric)
    else:
        rows = lines.groupBy(F.col(column).alias("series_key"), period).agg(exact_sum(metric).alias("value"))
    return rows.select(F.lit(level).alias("level"), "series_key", "period_start", "value")


# Partitions of series for each core, at least, and bytes of input files for each of them, at most.
SERIES_PARTITIONS = 16
SERIES_BYTES = 2 << 20
# Bytes of input files for each core up to which lines are summed in the tasks that read or join them.
LINE_BYTES = 16 << 20
# Parts that the lines of a member in a period are summed in, where the input is large.
DEALS = 1024


def least_tasks(spark: SparkSession) -> int:
    """Partitions by series of a small input: as many as the session shuffles to, or 16 for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), SERIES_PARTITIONS * spark.sparkContext.defaultParallelism)


def series_tasks(df: DataFrame) -> int:
    """Partitions by series for a frame: those of a small input, more where its input files are large."""
    return max(least_tasks(df.sparkSession), input_bytes(df) // SERIES_BYTES)


def large_input(lines: DataFrame) -> bool:
    """Whether lines are too many to be summed in the tasks that read or join them."""
    return input_bytes(lines) > LINE_BYTES * lines.sparkSession.sparkContext.defaultParallelism


def spread_lines(lines: DataFrame, *columns: str) -> DataFrame:
    """Lines of a large input dealt evenly into as many partitions as its series.

    Tasks that read or join lines take in millions of them, whose sums by item and period are almost as many and lie in
    memory at once. The columns hold a day and a measure, so a member that owns a large part of the lines is spread too.
    """
    return lines.repartition(series_tasks(lines), *columns) if large_input(lines) else lines


def spread_sums(lines: DataFrame, member: str, period: Column, metric: str) -> DataFrame:
    """Sums of a large input by member and period, first within deals of a period's lines by day and value, then over the deals.

    Both steps have as many partitions as the series. Spark would merge the shuffle of the sums to 64 MB a task, which are
    millions of sums at once.
    """
    deal = F.pmod(F.hash("booked_date", metric), F.lit(DEALS)).alias("deal")
    names = ("whole", "millionths", "finest")
    dealt = spread_lines(lines.select(member, period, deal, metric), member, "period_start", "deal")
    parts = [F.sum(part).alias(name) for name, part in zip(names, exact_parts(metric))]
    sums = dealt.groupBy(member, "period_start", "deal").agg(*parts)
    dealt = sums.repartition(series_tasks(lines), member, "period_start")
    return dealt.groupBy(F.col(member).alias("series_key"), "period_start").agg(exact_total([F.col(name) for name in names]).alias("value"))


def by_series(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Hash rows by series into ``tasks`` partitions, or those of a small input.

    Series are short, so partitions are even. Their number is given: Spark would merge partitions by their bytes, which
    are few, but rows grow a hundredfold within the task (states of 100 columns, steps, methods), and so does its memory.
    """
    return df.repartition(tasks or least_tasks(df.sparkSession), "series_key")


def kept_series(indexed: DataFrame) -> DataFrame:
    """Indexed series computed once, for several readers. A checkpoint forgets its partitioning, so they are dealt out again,
    into as many partitions."""
    kept = cut_lineage(indexed.sparkSession, indexed)
    return by_series(kept, max(least_tasks(kept.sparkSession), kept.rdd.getNumPartitions()))


def index_series(series: DataFrame, freq: str = "M") -> DataFrame:
    """Add the step number ``t`` from the first period of the series and its length ``n``.

    Works on the sparse rows: a period without lines has no row and counts as zero
    demand. Group size is bounded by the number of periods in the calendar.
    """
    whole = Window.partitionBy("series_key")
    o = ordinal(F.col("period_start"), freq)
    first, last = F.min("o").over(whole), F.max("o").over(whole)
    return (
        by_series(series, series_tasks(series))
        .withColumn("o", o)
        .withColumn("t", F.col("o") - first)
        .withColumn("n", last - first + 1)
        .drop("o")
    )


def densify(series: DataFrame, freq: str = "M", min_periods: int = 1) -> DataFrame:
    """Dense series ``(level, series_key, t, period_start, value)`` with zeros in the gaps.

    Every row is unfolded into itself and the empty periods up to the next row of its
    series. That is the calendar left join without the join: one shuffle, by series.
    Series shorter than ``min_periods`` are left out.
    """
    return unfolded(index_series(series, freq), freq, min_periods)


def unfolded(indexed: DataFrame, freq: str = "M", min_periods: int = 1) -> DataFrame:
    """``densify`` for series that are indexed already."""
    order = Window.partitionBy("series_key").orderBy("t")
    following = F.coalesce(F.lead("t").over(order), F.col("t") + 1)
    gap = F.sequence(F.lit(0), following - F.col("t") - 1)
    return (
        indexed.where(F.col("n") >= min_periods)
        .withColumn("gap", gap)
        .select("level", "series_key", "t", "period_start", "value", F.explode("gap").alias("k"))
        .select(
            "level",
            "series_key",
            (F.col("t") + F.col("k")).cast("int").alias("t"),
            shift(F.col("period_start"), F.col("k"), freq).alias("period_start"),
            F.when(F.col("k") == 0, F.col("value")).otherwise(0.0).alias("value"),
        )
    )


def series_status(series: DataFrame, freq: str = "M", cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """One verdict per series: ok, insufficient (too few periods) or zero (metric sums to 0)."""
    o = ordinal(F.col("period_start"), freq)
    per = series.groupBy("series_key").agg(
        (F.max(o) - F.min(o) + 1).cast("int").alias("n"), exact_sum("value").alias("total")
    )
    status = (
        F.when(F.round("total", 9) == 0, "zero").when(F.col("n") < cfg.min_periods, "insufficient").otherwise("ok")
    )
    reason = F.when(status == "zero", F.lit("metric has no data")).when(
        status == "insufficient",
        F.format_string(f"history of %d periods is shorter than {cfg.min_periods}", "n"),
    )
    return per.withColumn("status", status).withColumn("reason", reason)


def with_totals(indexed: DataFrame) -> DataFrame:
    """Add ``total``, the sum of the series to nine decimals."""
    return indexed.withColumn("total", F.round(F.sum("value").over(Window.partitionBy("series_key")), 9))


def forecastable(indexed: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Indexed series that ``series_status`` calls ok: long enough, and not zero in sum (to nine decimals). Those that have
    a ``total`` are not summed again."""
    long = indexed.where(F.col("n") >= cfg.min_periods)
    return (long if "total" in long.columns else with_totals(long)).where("total != 0").drop("total")


def yearly_totals(series: DataFrame) -> DataFrame:
    """Calendar-year totals of every series, with 0 for years without lines between its first and last."""
    years = series.groupBy("series_key", F.year("period_start").alias("year")).agg(exact_sum("value").alias("value"))
    following = F.coalesce(F.lead("year").over(Window.partitionBy("series_key").orderBy("year")), F.col("year") + 1)
    years = years.withColumn("gap", F.sequence(F.lit(0), following - F.col("year") - 1))
    unfolded = years.select("series_key", "year", "value", F.explode("gap").alias("k"))
    return unfolded.select("series_key", (F.col("year") + F.col("k")).alias("year"), F.when(F.col("k") == 0, F.col("value")).otherwise(0.0).alias("value"))
