"""Readers for order lines, item lists and the system alias table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from tallycast.config import OPTIONAL_RAW_COLUMNS, REQUIRED_RAW_COLUMNS
from tallycast.functions.columns import clean_code

FORMATS = ("csv", "parquet", "json", "orc")


def _reader(spark: SparkSession, fmt: str):
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", False).option("escape", '"')
    return reader.format(fmt)


def check_required(df: DataFrame) -> DataFrame:
    """Fail at plan time, naming every required column that is absent."""
    missing = [c for c in REQUIRED_RAW_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"order lines lack required columns: {missing}")
    return df


def read_orders(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw order lines. Text formats are read as strings; cleaning does the casts."""
    try:
        if fmt == "json":
            fields = [T.StructField(c, T.StringType()) for c in REQUIRED_RAW_COLUMNS + OPTIONAL_RAW_COLUMNS]
            return check_required(_reader(spark, fmt).schema(T.StructType(fields)).load(path))
        return check_required(_reader(spark, fmt).load(path))
    except AnalysisException as e:
        raise ValueError(f"cannot read order lines from {path!r}: {e}") from e


def item_codes(df: DataFrame) -> DataFrame:
    """Distinct cleaned item codes of the first column, as ``sku``."""
    first = F.col(f"`{df.columns[0]}`")
    return df.where(first.isNotNull()).select(clean_code(first).alias("sku")).distinct()


def read_item_list(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One lookup list of item codes; a path that does not exist gives an empty list."""
    try:
        return item_codes(_reader(spark, fmt).load(path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], "sku string")


def read_item_lists(spark: SparkSession, standard: str, prime: str, fmt: str = "parquet") -> DataFrame:
    """Both lists as one flag table ``(sku, is_standard, is_prime)``."""
    return item_flags(read_item_list(spark, standard, fmt), read_item_list(spark, prime, fmt))


def item_flags(standard: DataFrame, prime: DataFrame) -> DataFrame:
    """Merge the Standard and Prime lists into one row per item code."""
    std = standard.select("sku", F.lit(True).alias("s"), F.lit(False).alias("p"))
    prm = prime.select("sku", F.lit(False).alias("s"), F.lit(True).alias("p"))
    return std.unionByName(prm).groupBy("sku").agg(
        F.bool_or("s").alias("is_standard"), F.bool_or("p").alias("is_prime")
    )


def alias_table(spark: SparkSession, mapping: dict[str, list[str]]) -> DataFrame:
    """Alias dictionary as a table ``(canonical, alias, ord)``; names without alias keep one null row.

    It is handed over as an Arrow table, whose size Spark knows when it plans joins.
    """
    names = [(canonical, alias) for canonical, aliases in mapping.items() for alias in aliases or [None]]
    columns = [pa.array(c, pa.string()) for c in zip(*names, strict=True)] if names else [pa.array([], pa.string())] * 2
    return spark.createDataFrame(pa.Table.from_arrays([*columns, pa.array(range(len(names)), pa.int32())], ["canonical", "alias", "ord"]))


def read_alias_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Alias table ``(canonical, alias, ord)`` kept in a file, so that it can be edited without code."""
    return _reader(spark, fmt).load(path).select("canonical", "alias", F.col("ord").cast("int").alias("ord"))
