"""Validation of raw order lines: one-row checks, split groups, rules and their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.config import FEW_ITEMS, LONG_HISTORY_YEARS, MAX_MISSING_PCT, EngineConfig
from tallycast.functions.columns import clean_code, ratio0, side_by_side
from tallycast.operators.cleaning import parse_booked_date
from tallycast.operators.rollups import distinct_counts


# Raw columns that hold numbers.
MEASURE_COLUMNS = (
    "SO Remaining Qty", "SO Line Amount EGP", "Shipped Amount [USD]", "Not Shipped Amount [USD]", "Shipped Qty",
    "Cancelled Qty", "Calculated Weight (Kg)", "Unit Weight (Kg)",
)


def _pct(part: Column, whole: Column) -> Column:
    return ratio0(part * 100.0, whole)


def missing_values(raw: DataFrame) -> DataFrame:
    """Rows, and count and percent of missing item, quantity and date."""
    return _with_missing_pct(raw.agg(*_missing()))


def _missing() -> list[Column]:
    named = {"missing_sku": "Ordered Item", "missing_qty": "SO Remaining Qty", "missing_date": "Booked Date"}
    return [F.count(F.lit(1)).alias("total_rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(k) for k, c in named.items())]


def _with_missing_pct(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_pct": _pct(F.col(c), F.col("total_rows")) for c in ("missing_sku", "missing_qty", "missing_date")})


def _dates(d: Column) -> list[Column]:
    return [F.min(d).alias("lo"), F.max(d).alias("hi")]


def _with_span(df: DataFrame) -> DataFrame:
    days = F.datediff("hi", "lo").cast("bigint")
    spans = {"date_min": F.col("lo").cast("date"), "date_max": F.col("hi").cast("date"), "span_days": days, "span_years": days / 365.25}
    return df.withColumns(spans).drop("lo", "hi")


def unreadable_values(raw: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """``(column, present, unreadable)``: values of dates and measures that are there but cannot be read.

    Lines with an unreadable date are dropped by cleaning, unreadable numbers count 0; this says how many.
    """
    read = {"Booked Date": parse_booked_date(raw, cfg)}
    read |= {c: F.col(f"`{c}`").try_cast("double") for c in MEASURE_COLUMNS if c in raw.columns}
    there = {c: F.col(f"`{c}`").isNotNull() & (F.btrim(F.col(f"`{c}`").cast("string")) != "") for c in read}
    counts = [F.struct(F.lit(c).alias("column"), F.count_if(there[c]).alias("present"), F.count_if(there[c] & x.isNull()).alias("unreadable")) for c, x in read.items()]
    return raw.agg(F.array(*counts).alias("rows")).select(F.inline("rows"))


def duplicate_rows(raw: DataFrame) -> DataFrame:
    """Rows beyond the first of their kind, all columns compared.

    Repeats are counted on the map side first, so a row copied very often is one
    partial row per task in the shuffle.
    """
    counts = raw.groupBy(*[F.col(f"`{c}`") for c in raw.columns]).agg(F.count(F.lit(1)).alias("copies"))
    return counts.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def item_classification(raw: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows in the Standard and the Prime list. Here non-standard is rows minus standard rows."""
    items = raw.where(F.col("`Ordered Item`").isNotNull()).select(clean_code(F.col("`Ordered Item`")).alias("sku"))
    per_item = items.groupBy("sku").agg(F.count(F.lit(1)).alias("n")).join(flags, "sku", "left")
    out = per_item.agg(
        F.coalesce(F.sum(F.when(F.col("is_standard"), F.col("n"))), F.lit(0)).alias("standard_items"),
        F.coalesce(F.sum(F.when(F.col("is_prime"), F.col("n"))), F.lit(0)).alias("prime_items"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
    )
    return out.select(
        "standard_items",
        "prime_items",
        (F.col("n") - F.col("standard_items")).alias("non_standard_items"),
        _pct(F.col("standard_items"), F.col("n")).alias("standard_pct"),
        _pct(F.col("prime_items"), F.col("n")).alias("prime_pct"),
    )


def date_range(raw: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """First and last readable booking date, span in days and years."""
    return _with_span(raw.select(parse_booked_date(raw, cfg).alias("d")).agg(*_dates(F.col("d"))))


def raw_cardinalities(raw: DataFrame) -> DataFrame:
    """Distinct raw items, orders and dimension members; an absent column counts 0."""
    return distinct_counts(
        raw,
        {
            "unique_items": "Ordered Item",
            "unique_orders": "Order Number",
            "unique_countries": "Country",
            "unique_systems": "Order System",
            "unique_factories": "Factory Name",
            "unique_cells": "Cell Columns",
        },
    )


def split_groups(raw: DataFrame) -> DataFrame:
    """(order, item) groups and those with more than one row; rows with a missing key do not count."""
    order, item = F.col("`Order Number`"), F.col("`Ordered Item`")
    groups = raw.where(order.isNotNull() & item.isNotNull()).groupBy(order, item).agg(F.count(F.lit(1)).alias("n"))
    out = groups.agg(F.count_if(F.col("n") > 1).alias("split_groups"), F.count(F.lit(1)).alias("total_groups"))
    return out.withColumn("split_percentage", _pct(F.col("split_groups"), F.col("total_groups")))


def _per_line(raw: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The checks that one pass over the lines gives: rows, missing values, dates."""
    counted = raw.withColumn("d", parse_booked_date(raw, cfg)).agg(*_missing(), *_dates(F.col("d")))
    return _with_span(_with_missing_pct(counted))


def validation(raw: DataFrame, flags: DataFrame | None = None, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """All checks joined into one row of plain numbers.

    The lines are read three times: as they are for repeats, once for all distinct counts, and once for the counts by
    (order, item), of which rows, missing values, dates, split groups and list members are sums.
    """
    keys = [c for c in ("Order Number", "Ordered Item") if c in raw.columns]
    groups = raw.withColumn("d", parse_booked_date(raw, cfg)).groupBy(*[F.col(f"`{c}`") for c in keys]).agg(*_missing(), *_dates(F.col("d")))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_rows", "missing_sku", "missing_qty", "missing_date")]
    aggs = [*sums, F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    named = F.col("`Ordered Item`").isNotNull()
    if "Order Number" in raw.columns:
        whole = named & F.col("`Order Number`").isNotNull()
        aggs += [F.count_if(whole & (F.col("total_rows") > 1)).alias("split_groups"), F.count_if(whole).alias("total_groups")]
    if flags is not None:
        groups = groups.withColumn("sku", clean_code(F.col("`Ordered Item`"))).join(flags, "sku", "left")
        aggs += [F.coalesce(F.sum(F.when(named & F.col(flag), F.col("total_rows"))), F.lit(0)).alias(name) for name, flag in (("standard_items", "is_standard"), ("prime_items", "is_prime"))]
        aggs.append(F.coalesce(F.sum(F.when(named, F.col("total_rows"))), F.lit(0)).alias("n"))
    one = _with_span(_with_missing_pct(groups.agg(*aggs)))
    if "Order Number" in raw.columns:
        one = one.withColumn("split_percentage", _pct(F.col("split_groups"), F.col("total_groups")))
    if flags is not None:
        one = one.withColumns({"non_standard_items": F.col("n") - F.col("standard_items"), "standard_pct": _pct(F.col("standard_items"), F.col("n")), "prime_pct": _pct(F.col("prime_items"), F.col("n"))}).drop("n")
    return side_by_side([one, duplicate_rows(raw), raw_cardinalities(raw)])


def rule_inputs(raw: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """The checks that ``quality_rules`` reads, in one row: missing values, dates and the number of items."""
    items = distinct_counts(raw, {"unique_items": "Ordered Item"})
    return side_by_side([_per_line(raw, cfg), items])


def validation_long(checks: DataFrame) -> DataFrame:
    """The numeric checks as rows ``(metric, value)``."""
    names = [f.name for f in checks.schema if f.dataType.simpleString() != "date"]
    pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return checks.selectExpr(f"stack({len(names)}, {pairs}) as (metric, value)")


def quality_rules(checks: DataFrame) -> DataFrame:
    """Verdicts ``(rule, observed, threshold, severity, fired)`` from a validation row."""
    rules = [
        ("missing_sku_pct", F.col("missing_sku_pct"), MAX_MISSING_PCT["sku"], "warning", ">"),
        ("missing_date_pct", F.col("missing_date_pct"), MAX_MISSING_PCT["date"], "warning", ">"),
        ("few_items", F.col("unique_items"), float(FEW_ITEMS), "recommendation", "<"),
        ("long_history", F.col("span_years"), LONG_HISTORY_YEARS, "recommendation", ">="),
        ("short_history", F.col("span_years"), LONG_HISTORY_YEARS, "warning", "<"),
    ]
    structs = []
    for name, observed, limit, severity, op in rules:
        observed = observed.cast("double")
        fired = {">": observed > limit, "<": observed < limit, ">=": observed >= limit}[op]
        structs.append(
            F.struct(
                F.lit(name).alias("rule"),
                observed.alias("observed"),
                F.lit(limit).alias("threshold"),
                F.lit(severity).alias("severity"),
                F.coalesce(fired, F.lit(False)).alias("fired"),
            )
        )
    return checks.select(F.inline(F.array(*structs)))


def _canonical(df: DataFrame, name: str) -> Column:
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        c = c.try_cast("decimal(38,9)")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.coalesce(c.cast("string"), F.lit("\\N"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a hash sum of the input that do not depend on row order, column order or partitioning.

    Any tool can recompute it: a row is its values in order of column name with U+001F between them; numbers with nine
    decimals, dates as yyyy-MM-dd, timestamps with microseconds, nulls as ``\\N``. The first fifteen hexadecimal digits
    of the row's MD5 are a number, and ``input_hash`` is the sum over all rows.
    """
    text = F.concat_ws("\x1f", *[_canonical(df, c) for c in sorted(df.columns)])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("input_hash"))
