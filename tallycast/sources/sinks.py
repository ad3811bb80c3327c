"""Writers. A failed write raises; nothing is swallowed."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_processed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Processed fact as Parquet, one folder per year.

    Rows are sent to their year before the write. The shuffle is a rebalance: Spark cuts a
    year that holds most of the rows into pieces of its advisory size and joins small years.
    """
    df.hint("rebalance", "year").write.mode(mode).partitionBy("year").parquet(path)


def write_views(views: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One Parquet folder per dimensional view."""
    for name, view in views.items():
        view.write.mode(mode).parquet(f"{folder}/view_{name}")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Summary or validation rows as JSON."""
    df.write.mode(mode).json(path)


def write_report_csv(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Forecast report as CSV with a header."""
    report.write.mode(mode).option("header", True).csv(path)


def write_report_tables(
    report: DataFrame, metadata: DataFrame, accuracy: DataFrame, folder: str, mode: str = "errorifexists"
) -> None:
    """The three tables of the full export: forecast, metadata, accuracy metrics."""
    for name, df in {"forecast": report, "metadata": metadata, "accuracy_metrics": accuracy}.items():
        df.write.mode(mode).option("header", True).csv(f"{folder}/{name}")
