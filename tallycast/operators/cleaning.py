"""From raw order lines to the processed fact: clean, classify, merge splits, derive."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.config import EngineConfig
from tallycast.functions.columns import clean_code, clean_text, exact_sum, number_or_zero, ratio0, text_or_unknown
from tallycast.functions.periods import period_start
from tallycast.operators.lookups import normalize_system
from tallycast.sources.orders import check_required

MEASURES = ("qty", "egp_amount", "usd_amount", "weight_tons", "shipped_qty", "cancelled_qty")
LINE_KEYS = ("order_number", "sku", "booked_date", "country", "system", "factory", "cell", "item_class")

# Clean column -> raw columns it is computed from.
_INPUTS = {
    "order_number": ("Order Number",),
    "sku": ("Ordered Item",),
    "booked_date": ("Booked Date",),
    "country": ("Country",),
    "system": ("Order System",),
    "factory": ("Factory Name",),
    "cell": ("Cell Columns",),
    "item_class": ("Item Class",),
    "description": ("Description", "Ordered Item"),
    "qty": ("SO Remaining Qty",),
    "shipped_qty": ("Shipped Qty",),
    "cancelled_qty": ("Cancelled Qty",),
    "egp_amount": ("SO Line Amount EGP",),
    "usd_amount": ("Shipped Amount [USD]", "Not Shipped Amount [USD]"),
    "weight_tons": ("Calculated Weight (Kg)", "Unit Weight (Kg)", "SO Remaining Qty"),
}
CLEAN_COLUMNS = tuple(_INPUTS)


def raw_columns_for(columns: Iterable[str]) -> list[str]:
    """Raw columns that cleaning needs for the asked clean columns (and its row filters)."""
    need = {"Ordered Item", "Booked Date"}
    for c in columns:
        need.update(_INPUTS[c])
    return sorted(need)


def parse_booked_date(df: DataFrame, cfg: EngineConfig) -> Column:
    c = F.col("`Booked Date`")
    patterns = (cfg.date_format,) if isinstance(cfg.date_format, str) else cfg.date_format or ()
    if patterns and df.schema["Booked Date"].dataType.simpleString() == "string":
        return F.coalesce(*(F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz") for p in patterns))
    return c.try_cast("timestamp_ntz")


def clean_lines(
    raw: DataFrame,
    cfg: EngineConfig = EngineConfig(),
    aliases: DataFrame | None = None,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """Typed, trimmed order lines; rows without item code or booking date are dropped.

    ``columns`` narrows the output, so that a query over two columns reads two
    columns; without it all columns come out and the required ones are checked.
    """
    if columns is None:
        check_required(raw)
        columns = CLEAN_COLUMNS
    columns = list(columns)

    sku = clean_code(F.col("`Ordered Item`"))
    qty = number_or_zero(raw, "SO Remaining Qty")
    calculated = number_or_zero(raw, "Calculated Weight (Kg)")
    kg = F.when(calculated > 0, calculated).otherwise(number_or_zero(raw, "Unit Weight (Kg)") * qty)
    exprs = {
        "order_number": text_or_unknown(raw, "Order Number"),
        "sku": sku,
        "booked_date": parse_booked_date(raw, cfg),
        "country": text_or_unknown(raw, "Country"),
        "system": text_or_unknown(raw, "Order System"),
        "factory": text_or_unknown(raw, "Factory Name"),
        "cell": text_or_unknown(raw, "Cell Columns"),
        "item_class": text_or_unknown(raw, "Item Class"),
        "description": clean_text(F.col("Description")) if "Description" in raw.columns else sku,
        "qty": qty,
        "shipped_qty": number_or_zero(raw, "Shipped Qty"),
        "cancelled_qty": number_or_zero(raw, "Cancelled Qty"),
        "egp_amount": number_or_zero(raw, "SO Line Amount EGP"),
        "usd_amount": number_or_zero(raw, "Shipped Amount [USD]") + number_or_zero(raw, "Not Shipped Amount [USD]"),
        "weight_tons": kg / 1000,
    }
    wanted = list(dict.fromkeys(["sku", "booked_date", *columns]))
    carried = [c for c in ("row_order",) if c in raw.columns]
    df = raw.select(*[exprs[c].alias(c) for c in wanted], *carried)
    df = df.where(F.col("sku").isNotNull() & (F.col("sku") != "NAN") & F.col("booked_date").isNotNull())
    if "system" in columns:
        df = normalize_system(df, aliases) if aliases is not None else df
    return df.select(*columns, *carried)


def classify_items(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Add ``item_category``: Prime before Standard before Non-Standard.

    One left join with the merged flag table; Spark broadcasts it while it is under
    the session's threshold and sort-merges (with skew splitting) beyond.
    """
    category = (
        F.when(F.col("is_prime"), "Prime").when(F.col("is_standard"), "Standard").otherwise("Non-Standard")
    )
    return df.join(flags, "sku", "left").withColumn("item_category", category).drop("is_standard", "is_prime")


def with_calendar(df: DataFrame) -> DataFrame:
    """Add year, quarter, month, ISO week and the four period start dates."""
    d = F.col("booked_date")
    return df.withColumns(
        {
            "year": F.year(d),
            "quarter": F.quarter(d),
            "month": F.month(d),
            "week": F.weekofyear(d),
            "period_year": period_start(d, "Y"),
            "period_quarter": period_start(d, "Q"),
            "period_month": period_start(d, "M"),
            "period_week": period_start(d, "W"),
        }
    )


# Parts that the lines of an item are dealt into.
DEALS = 16


def dealt_lines(df: DataFrame) -> DataFrame:
    """Lines with their ``deal``, shuffled by item and deal: lines to merge meet, and items can be joined where these lie.

    The deal depends on the other keys, so an item that owns a large part of the lines is spread over many tasks. Lines go
    into the shuffle as they are; hardly any are merged before, and three sums for each measure would be twice as wide.
    """
    other = [c for c in LINE_KEYS if c in df.columns and c != "sku"]
    return df.withColumn("deal", F.pmod(F.hash(*other), F.lit(DEALS))).repartition("sku", "deal")


def dealt_items(items: DataFrame) -> DataFrame:
    """A row of each item for each deal."""
    return items.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))


def merge_splits(df: DataFrame) -> DataFrame:
    """Sum the measures of lines that agree in every key; missing keys form groups too.

    The calendar columns and the item category depend on these keys, so they stay out
    of the shuffle and are added to the merged rows. Lines that are dealt keep their deal and are merged where they lie.
    """
    keys = [c for c in (*LINE_KEYS, "deal") if c in df.columns]
    sums = [exact_sum(m).alias(m) for m in MEASURES if m in df.columns]
    return df.groupBy(*keys).agg(*sums)


def item_descriptions(df: DataFrame) -> DataFrame:
    """One description per item: of its distinct texts, the one that first appears last.

    First appearance needs a ``row_order`` column; without one the greatest text is taken.
    """
    if "row_order" not in df.columns:
        return df.groupBy("sku").agg(F.max("description").alias("description"))
    first = df.groupBy("sku", "description").agg(F.min("row_order").alias("first_seen"))
    return first.groupBy("sku").agg(F.max_by("description", "first_seen").alias("description"))


def derived_metrics(df: DataFrame) -> DataFrame:
    """Add ordered total, fulfilment rate and unit prices; undefined quotients are 0."""
    total = F.col("qty") + F.col("shipped_qty") + F.col("cancelled_qty")
    return df.withColumn("total_ordered", total).withColumns(
        {
            "fulfillment_rate": ratio0(F.col("shipped_qty"), F.col("total_ordered")) * 100,
            "unit_price_egp": ratio0(F.col("egp_amount"), F.col("qty")),
            "unit_price_usd": ratio0(F.col("usd_amount"), F.col("qty")),
        }
    )


def item_labels(df: DataFrame) -> DataFrame:
    """Distinct items with their display label; the code stays a column of its own."""
    items = df.select("sku", "description").distinct()
    return items.withColumn("label", F.concat_ws(" - ", "sku", "description"))
