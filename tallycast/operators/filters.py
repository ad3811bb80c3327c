"""Row filters; all of them reach the scan when the data is partitioned or has statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycast.config import Filters


def _in_list(df: DataFrame, column: str, values: tuple, all_marker: str | None = None) -> DataFrame:
    """Rows whose column is in the list; a list on a column that the frame lacks raises."""
    if not values or (all_marker and all_marker in values):
        return df
    if column not in df.columns:
        raise ValueError(f"cannot filter by {column!r}: the frame has no such column")
    return df.where(F.col(column).isin(*values))


def filter_years(df: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """Keep the listed years; compared as date ranges, so that the booking date can prune."""
    if not years:
        return df
    if "year" in df.columns:
        return _in_list(df, "year", years)
    d = F.col("booked_date")
    spans = [
        (d >= F.lit(f"{y:04d}-01-01").cast("timestamp_ntz")) & (d < F.lit(f"{y + 1:04d}-01-01").cast("timestamp_ntz"))
        for y in years
    ]
    return df.where(reduce(lambda a, b: a | b, spans))


def filter_period(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Keep months from start to end (``YYYY-MM``, both inclusive); only when both are given."""
    if not (start and end):
        return df
    lo = F.lit(f"{start}-01").cast("date")
    hi = F.add_months(F.lit(f"{end}-01").cast("date"), 1)
    d = F.col("booked_date")
    return df.where((d >= lo.cast("timestamp_ntz")) & (d < hi.cast("timestamp_ntz")))


def apply_filters(df: DataFrame, spec: Filters) -> DataFrame:
    """Conjunction of every filter that is set."""
    df = filter_years(df, spec.years)
    df = filter_period(df, spec.period_start, spec.period_end)
    df = _in_list(df, "country", spec.countries, "All Countries")
    df = _in_list(df, "system", spec.systems, "All Systems")
    df = _in_list(df, "factory", spec.factories, "All Factories")
    if spec.exclude_countries:
        df = df.where(~F.col("country").isin(*spec.exclude_countries))
    if spec.exclude_systems:
        df = df.where(~F.col("system").isin(*spec.exclude_systems))
    if spec.category:
        df = df.where(F.col("item_category") == spec.category)
    for column, value in spec.equals.items():
        if column in df.columns:
            df = df.where(F.col(column) == F.lit(value))
    return df


def search_items(df: DataFrame, text: str = "", limit: int = 50) -> DataFrame:
    """Items whose code or description matches the regular expression; without one the first ``limit``."""
    items = df.select("sku", "description").distinct()
    if not text:
        return items.orderBy("sku", "description").limit(limit)
    pattern = f"(?i){text}"
    return items.where(F.col("sku").rlike(pattern) | F.col("description").rlike(pattern))
