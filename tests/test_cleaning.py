import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallycast.config import EngineConfig, Filters
from tallycast.functions.columns import exact_sum, hashed_normal, hashed_uniform
from tallycast.operators import cleaning, filters, lookups, quality
from tallycast.sources import orders

COLUMNS = [
    "Ordered Item", "SO Remaining Qty", "Booked Date", "SO Line Amount EGP", "Shipped Amount [USD]",
    "Not Shipped Amount [USD]", "Order System", "Country", "Order Number", "Description",
    "Calculated Weight (Kg)", "Unit Weight (Kg)",
]
SCHEMA = ", ".join(f"`{c}` string" for c in COLUMNS)
ROWS = [
    ("  sku-a\t", "10", "2021-01-05", "100.5", "1", "2", "scaffold", " EGY ", "1", "first", "5", "1"),
    ("SKU-A", "-5", "2021-01-05", "bad", "", None, "Scaffold Tower", "EGY", "1", "second", "0", "2"),
    ("SKU-A", "-5", "2021-01-05", "bad", "", None, "Scaffold Tower", "EGY", "1", "second", "0", "2"),
    (None, "1", "2021-01-05", "1", "1", "1", "x", "y", "2", "d", None, None),
    ("nan", "1", "2021-01-05", "1", "1", "1", "x", "y", "2", "d", None, None),
    ("SKU-B", "NaN", "2021-02-28 10:30:00", "1d", "inf", "1e2", " nan ", "NAN", None, None, "x", "3"),
    ("SKU-C", "7", "not a date", "1", "1", "1", "x", "y", "3", "d", None, None),
    ("SKU-D", "7", "2021-12-31", "1", "1", "1", "", "Nan", "3", "d", None, "3"),
]
ALIASES = {"SYS1: Tower": ["Scaffold Tower", "SCAFFOLD"], "SYS2: Other": ["scaffold", "x"], "SYS3: Empty": []}


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clean(spark, raw):
    return cleaning.clean_lines(raw, aliases=orders.alias_table(spark, ALIASES))


def by_sku(df):
    return {r.sku: r for r in df.collect()}


def test_rows_without_item_or_date_go(clean):
    assert sorted(r.sku for r in clean.collect()) == ["SKU-A", "SKU-A", "SKU-A", "SKU-B", "SKU-D"]


def test_numbers_text_and_weight(clean):
    b, d = by_sku(clean)["SKU-B"], by_sku(clean)["SKU-D"]
    assert (b.qty, b.egp_amount, b.usd_amount, b.weight_tons) == (0.0, 0.0, 100.0, 0.0)
    assert (b.country, b.system, b.order_number, b.description) == ("Unknown",) * 4
    assert d.country == "Nan"  # only the exact texts nan and NAN mean missing
    assert d.system == "Unknown"
    assert d.weight_tons == pytest.approx(0.021)
    assert b.booked_date == dt.datetime(2021, 2, 28, 10, 30)
    assert (d.factory, d.cell, d.shipped_qty) == ("Unknown", "Unknown", 0.0)


def test_alias_first_entry_wins_without_case(clean):
    assert {r.system for r in clean.where("sku = 'SKU-A'").collect()} == {"SYS1: Tower"}


def test_canonical_name_is_case_sensitive(spark):
    table = orders.alias_table(spark, ALIASES)
    df = spark.createDataFrame([("SYS3: Empty",), ("sys3: empty",), ("X",), ("y",), (None,)], "system string")
    got = sorted(r.system for r in lookups.normalize_system(df, table).collect())
    assert got == ["SYS2: Other", "SYS3: Empty", "Unknown", "sys3: empty", "y"]
    assert [r.alias for r in lookups.system_aliases(table, "SYS1: Tower").collect()] == ["Scaffold Tower", "SCAFFOLD"]


def test_pruned_cleaning_equals_full(raw, clean):
    part = cleaning.clean_lines(raw, columns=["sku", "weight_tons"])
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, clean.select("sku", "weight_tons").collect()))


def test_required_columns(spark):
    with pytest.raises(ValueError, match="Booked Date"):
        cleaning.clean_lines(spark.createDataFrame([("a", "1")], "`Ordered Item` string, `SO Remaining Qty` string"))


def test_date_format(spark):
    df = spark.createDataFrame([("A", "1", "05/02/2021", "1", "1", "1"), ("B", "1", "2021-01-01", "1", "1", "1")],
                               ", ".join(f"`{c}` string" for c in COLUMNS[:6]))
    got = cleaning.clean_lines(df, EngineConfig(date_format="dd/MM/yyyy")).collect()
    assert [(r.sku, r.booked_date) for r in got] == [("A", dt.datetime(2021, 2, 5))]


def test_splits_merge_and_keep_null_keys(clean):
    merged = cleaning.merge_splits(clean.withColumn("order_number", F.when(F.col("sku") != "SKU-B", F.col("order_number"))))
    rows = by_sku(merged)
    assert len(rows) == 3 and rows["SKU-B"].order_number is None
    assert rows["SKU-A"].qty == 0.0 and rows["SKU-A"].egp_amount == 100.5


def test_categories(spark, clean):
    std = orders.item_codes(spark.createDataFrame([(" sku-a ",), ("SKU-D",), ("SKU-D",), (None,)], "code string"))
    prime = orders.item_codes(spark.createDataFrame([("SKU-D",)], "code string"))
    flags = orders.item_flags(std, prime)
    got = {r.sku: r.item_category for r in cleaning.classify_items(clean, flags).collect()}
    assert got == {"SKU-A": "Standard", "SKU-B": "Non-Standard", "SKU-D": "Prime"}


def test_calendar(clean):
    d = by_sku(cleaning.with_calendar(clean))["SKU-D"]
    assert (d.year, d.quarter, d.month, d.week) == (2021, 4, 12, 52)
    assert (d.period_quarter, d.period_week) == (dt.date(2021, 10, 1), dt.date(2021, 12, 27))


def test_derived_metrics(spark):
    df = spark.createDataFrame([(2.0, 3.0, -1.0, 10.0, 5.0), (0.0, 0.0, 0.0, 10.0, 5.0), (-2.0, 1.0, 0.0, 4.0, 2.0)],
                               "qty double, shipped_qty double, cancelled_qty double, egp_amount double, usd_amount double")
    got = [tuple(r)[5:] for r in cleaning.derived_metrics(df).collect()]
    assert got == [(4.0, 75.0, 5.0, 2.5), (0.0, 0.0, 0.0, 0.0), (-1.0, -100.0, -2.0, -1.0)]


def test_description_is_the_text_that_appears_last(spark):
    rows = [("A", "x", 1), ("A", "y", 2), ("A", "x", 3), ("B", "z", 4)]
    df = spark.createDataFrame(rows, "sku string, description string, row_order long")
    assert {r.sku: r.description for r in cleaning.item_descriptions(df).collect()} == {"A": "y", "B": "z"}


def test_quality(spark, raw):
    std = orders.item_codes(spark.createDataFrame([("sku-a",)], "code string"))
    prime = orders.item_codes(spark.createDataFrame([("sku-a",), ("SKU-B",)], "code string"))
    row = quality.validation(raw, orders.item_flags(std, prime)).first()
    assert (row.total_rows, row.missing_sku, row.duplicates) == (8, 1, 1)
    assert (row.standard_items, row.prime_items, row.non_standard_items) == (3, 4, 4)
    assert (row.split_groups, row.total_groups) == (1, 5)
    assert row.unique_factories == 0 and row.unique_items == 6
    rules = {r.rule: r for r in quality.quality_rules(quality.validation(raw)).collect()}
    assert rules["missing_sku_pct"].observed == 12.5 and rules["missing_sku_pct"].fired
    assert rules["few_items"].fired and rules["short_history"].fired and not rules["long_history"].fired


def test_fingerprint_ignores_order(spark, raw):
    assert quality.fingerprint(raw).first() == quality.fingerprint(raw.orderBy(F.desc("Ordered Item")).repartition(5)).first()


def test_exact_sum(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.2, -0.3, 1e9, -1e9, 845791.2000000001, -0.000001)], "x double")
    assert df.agg(exact_sum("x").alias("s")).first().s == 845791.199999
    assert spark.createDataFrame([], "x double").agg(exact_sum("x").alias("s")).first().s is None


def test_hashed_draws(spark):
    df = spark.range(20000).select(hashed_uniform(7, F.col("id")).alias("u"), hashed_normal(7, F.col("id")).alias("z"))
    row = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("z"), F.stddev("z")).first()
    assert 0 <= row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.01
    assert abs(row[3]) < 0.03 and abs(row[4] - 1) < 0.03


def test_exact_sum_keeps_small_values_and_large_sums(spark):
    df = spark.range(1_000_000).select(F.lit(3e-7).alias("x"))
    assert abs(df.agg(exact_sum("x").alias("s")).first().s - 0.3) < 1e-12
    big = spark.createDataFrame([(1e15,), (0.5,), (-3.25,), (2e-9,)], "x double")
    assert big.agg(exact_sum("x").alias("s")).first().s == 1e15 - 2.75
    cents = spark.createDataFrame([(136844.87,), (0.0,)], "x double")
    assert cents.agg(exact_sum("x").alias("s")).first().s == 136844.87


def test_several_date_patterns(spark):
    rows = [("2020-03-01", "A"), ("02/04/2020", "B"), ("20200503", "C"), ("soon", "D"), (None, "E")]
    raw = spark.createDataFrame(rows, "`Booked Date` string, `Ordered Item` string")
    cfg = EngineConfig(date_format=("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd"))
    got = {r.sku: str(r.booked_date)[:10] for r in cleaning.clean_lines(raw, cfg, columns=["sku", "booked_date"]).collect()}
    assert got == {"A": "2020-03-01", "B": "2020-04-02", "C": "2020-05-03"}
    counts = {r["column"]: (r.present, r.unreadable) for r in quality.unreadable_values(raw, cfg).collect()}
    assert counts == {"Booked Date": (4, 1)}


def test_filter_on_an_absent_column_raises(spark):
    with pytest.raises(ValueError, match="country"):
        filters.apply_filters(spark.range(1), Filters(countries=("X",)))
