"""Dimensional views, totals, top-k, shares, trends and hierarchies of the processed fact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.functions.columns import exact_sum, ratio0, side_by_side

VIEW_MEASURES = ("qty", "egp_amount", "usd_amount", "weight_tons")
CATEGORIES = ("Standard", "Prime", "Non-Standard")


def monthly_sku_view(df: DataFrame) -> DataFrame:
    """Item x month x category totals; the month column is also the period start."""
    sums = [exact_sum(m).alias(m) for m in VIEW_MEASURES]
    out = df.groupBy("sku", "period_month", "item_category").agg(*sums)
    return out.withColumn("period_start", F.col("period_month"))


def dimension_view(df: DataFrame, dim: str) -> DataFrame:
    """Dimension x month totals with the number of distinct items.

    Spark plans the single distinct count by grouping on (dim, month, item) first, so a
    dimension member that holds a large part of the rows is spread over its items.
    """
    sums = [exact_sum(m).alias(m) for m in VIEW_MEASURES]
    return df.groupBy(dim, "period_month").agg(*sums, F.countDistinct("sku").alias("unique_skus"))


def totals_by(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Sums of the measures by the keys."""
    return df.groupBy(*keys).agg(*[exact_sum(m).alias(m) for m in measures])


def top_k(df: DataFrame, dim: str, measure: str, k: int) -> DataFrame:
    """The k members with the largest total; ties go to the smaller member name."""
    return totals_by(df, [dim], [measure]).orderBy(F.desc(measure), F.asc(dim)).limit(k)


def ranked(df: DataFrame, dim: str, measure: str, k: int) -> DataFrame:
    """``top_k`` with its rank; the window sees k rows."""
    order = Window.orderBy(F.desc(measure), F.asc(dim))
    return top_k(df, dim, measure, k).withColumn("rank", F.row_number().over(order))


def top_k_per_group(df: DataFrame, group: str, dim: str, measure: str, k: int) -> DataFrame:
    """The k largest members of every group, ranked."""
    totals = totals_by(df, [group, dim], [measure])
    order = Window.partitionBy(group).orderBy(F.desc(measure), F.asc(dim))
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share(df: DataFrame, dim: str, measure: str, k: int) -> DataFrame:
    """Percent of each of the top k members in the total of the shown members."""
    shown = top_k(df, dim, measure, k)
    total = F.sum(measure).over(Window.partitionBy())
    return shown.withColumn("share_pct", ratio0(F.col(measure), total) * 100)


def trend(df: DataFrame, dim: str, measure: str, k: int) -> DataFrame:
    """Month x member totals of the top k members.

    The lines are aggregated once to (member, month); both the ranking and the result
    come from that table. The broadcast side has k rows.
    """
    monthly = totals_by(df, [dim, "period_month"], [measure])
    top = top_k(monthly, dim, measure, k).select(dim)
    return monthly.join(F.broadcast(top), dim, "left_semi")


def scaled_pair(df: DataFrame, dim: str, a: str, b: str, k: int) -> DataFrame:
    """Top k by ``a`` with ``b`` drawn on the scale of ``a``: b * max(a) / max(b), 0 if max(b) <= 0."""
    shown = totals_by(df, [dim], [a, b]).orderBy(F.desc(a), F.asc(dim)).limit(k)
    everything = Window.partitionBy()
    top_a, top_b = F.max(a).over(everything), F.max(b).over(everything)
    scaled = F.when(top_b > 0, F.col(b) * top_a / top_b).otherwise(0.0)
    return shown.withColumn(f"{b}_scaled", scaled)


def kpis(df: DataFrame, dim: str | None = None, measures: tuple[str, ...] = VIEW_MEASURES) -> DataFrame:
    """One row of headline numbers over merged lines: rows, totals, members, rows per member."""
    aggs = [F.count(F.lit(1)).alias("rows"), *[exact_sum(m).alias(m) for m in measures]]
    if dim is None:
        return df.agg(*aggs)
    out = df.agg(*aggs, F.countDistinct(dim).alias("members"))
    return out.withColumn("rows_per_member", ratio0(F.col("rows"), F.col("members")))


def order_count_histogram(df: DataFrame, dim: str, width: int) -> DataFrame:
    """Members by number of rows, in bins of the given width."""
    counts = df.groupBy(dim).agg(F.count(F.lit(1)).alias("n"))
    low = (F.floor(F.col("n") / width) * width).cast("bigint")
    return counts.groupBy(low.alias("bin_start")).agg(F.count(F.lit(1)).alias("members"))


def pair_rollup(df: DataFrame, parent: str, child: str, measure: str, k: int) -> DataFrame:
    """The k largest (parent, child) pairs with the parent totals and the grand total over them."""
    pairs = totals_by(df, [parent, child], [measure])
    pairs = pairs.orderBy(F.desc(measure), F.asc(parent), F.asc(child)).limit(k)
    level = (2 - F.grouping(parent) - F.grouping(child)).cast("int").alias("depth")
    return pairs.rollup(parent, child).agg(exact_sum(measure).alias(measure), level)


def item_kpis(df: DataFrame) -> DataFrame:
    """Totals, distinct orders and category of every item."""
    return df.groupBy("sku").agg(
        exact_sum("qty").alias("qty"),
        exact_sum("usd_amount").alias("usd_amount"),
        F.countDistinct("order_number").alias("orders"),
        F.min("item_category").alias("item_category"),
    )


def distinct_counts(df: DataFrame, names: dict[str, Column | str]) -> DataFrame:
    """Exact distinct counts in one row, absent columns counting 0."""
    aggs = []
    for alias, c in names.items():
        if isinstance(c, str) and c not in df.columns:
            aggs.append(F.lit(0).cast("bigint").alias(alias))
        else:
            aggs.append(F.countDistinct(F.col(f"`{c}`") if isinstance(c, str) else c).alias(alias))
    return df.agg(*aggs)


def overview(df: DataFrame) -> DataFrame:
    """Rows, totals, first and last booking date and the days between them."""
    lo, hi = F.min("booked_date"), F.max("booked_date")
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        exact_sum("qty").alias("total_qty"),
        exact_sum("egp_amount").alias("total_egp"),
        exact_sum("usd_amount").alias("total_usd"),
        exact_sum("weight_tons").alias("total_tons"),
        lo.cast("date").alias("date_min"),
        hi.cast("date").alias("date_max"),
        F.datediff(hi, lo).cast("bigint").alias("span_days"),
    )


def item_statistics(df: DataFrame) -> DataFrame:
    """Distinct items overall and per category. An item has one category, so items are counted after they are grouped."""
    items = df.where("sku is not null").groupBy("sku").agg(F.collect_set("item_category").alias("in"))
    counts = {f"{c.lower().replace('-', '_')}_items": F.count_if(F.array_contains("in", c)) for c in CATEGORIES}
    return items.agg(F.count("*").alias("total_unique"), *(v.alias(k) for k, v in counts.items()))


def dimension_statistics(df: DataFrame) -> DataFrame:
    """Distinct members of each dimension."""
    return distinct_counts(
        df, {"countries": "country", "systems": "system", "factories": "factory", "cells": "cell", "years": "year"}
    )


# The five rankings of the summary.
RANKINGS = (
    ("top_items_by_qty", "sku", "qty"),
    ("top_items_by_usd", "sku", "usd_amount"),
    ("top_countries_by_usd", "country", "usd_amount"),
    ("top_systems_by_qty", "system", "qty"),
    ("top_factories_by_tons", "factory", "weight_tons"),
)


def top_performers(df: DataFrame, k: int = 10) -> DataFrame:
    """The summary's rankings as rows ``(ranking, rank, member, value)``.

    One pass over the lines adds up all dimensions (grouping sets); the rankings take the top k of that small table.
    """
    dims = list(dict.fromkeys(d for _, d, _ in RANKINGS))
    measures = list(dict.fromkeys(m for _, _, m in RANKINGS))
    sets = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims])
    which = F.coalesce(*(F.when(F.grouping(d) == 0, F.lit(d)) for d in dims))
    sums = sets.agg(*[exact_sum(m).alias(m) for m in measures], which.alias("dim"))
    members = sums.select("dim", F.coalesce(*(F.when(F.col("dim") == d, F.col(d)) for d in dims)).alias("member"), *measures)
    rows = [F.struct(F.lit(name).alias("ranking"), F.lit(d).alias("of"), F.col(m).alias("value")) for name, d, m in RANKINGS]
    long = members.select("dim", "member", F.inline(F.array(*rows))).where(F.col("dim") == F.col("of"))
    order = Window.partitionBy("ranking").orderBy(F.col("value").desc(), "member")
    ranked = long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("ranking", "rank", "member", "value")


def summary(df: DataFrame) -> DataFrame:
    """One nested row ``(overview, items, dimensions, top_performers)`` for the JSON sink."""

    def packed(one_row: DataFrame, name: str) -> DataFrame:
        return one_row.select(F.struct(*one_row.columns).alias(name))

    rows = F.collect_list(F.struct("ranking", "rank", "member", "value"))
    parts = [
        packed(overview(df), "overview"),
        packed(item_statistics(df), "items"),
        packed(dimension_statistics(df), "dimensions"),
        top_performers(df).agg(F.sort_array(rows).alias("top_performers")),
    ]
    return side_by_side(parts)
