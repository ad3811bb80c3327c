import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallycast.config import Filters
from tallycast.operators import filters, rollups

ROWS = [
    ("A", "red x", "EG", "S1", "F1", "C1", "O1", "Prime", 10.0, 1.0, 5.0, 0.1, dt.datetime(2020, 1, 5)),
    ("A", "red x", "EG", "S2", "F1", "C2", "O2", "Prime", 20.0, 2.0, 5.0, 0.1, dt.datetime(2020, 2, 5)),
    ("B", "blue y", "SA", "S1", "F2", "C1", "O2", "Standard", 30.0, 3.0, 0.0, 0.2, dt.datetime(2021, 2, 5)),
    ("C", "Red z", "AE", "S3", "F2", "C3", "O3", "Non-Standard", 30.0, 4.0, 0.0, 0.3, dt.datetime(2021, 3, 31, 23, 59)),
    ("C", "Red z", None, "S3", "F2", "C3", "O4", "Non-Standard", 5.0, 4.0, 0.0, 0.3, dt.datetime(2021, 4, 1)),
]
SCHEMA = """sku string, description string, country string, system string, factory string, cell string, order_number string,
  item_category string, qty double, egp_amount double, usd_amount double, weight_tons double, booked_date timestamp_ntz"""


@pytest.fixture(scope="module")
def fact(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumn("period_month", F.trunc("booked_date", "MONTH")).withColumn("year", F.year("booked_date"))


def test_views_keep_the_total_and_null_members(fact):
    view = rollups.dimension_view(fact, "country")
    assert view.agg(F.sum("qty")).first()[0] == 95.0
    assert view.where("country IS NULL").count() == 1
    assert rollups.monthly_sku_view(fact).agg(F.sum("qty")).first()[0] == 95.0


def test_top_k_breaks_ties_by_name(fact):
    assert [r.country for r in rollups.top_k(fact.where("country IS NOT NULL"), "country", "qty", 2).collect()] == ["AE", "EG"]
    per_factory = rollups.top_k_per_group(fact, "factory", "cell", "qty", 1).collect()
    assert {(r.factory, r.cell) for r in per_factory} == {("F1", "C2"), ("F2", "C3")}


def test_share_sums_to_100(fact):
    assert rollups.share(fact, "system", "qty", 2).agg(F.sum("share_pct")).first()[0] == pytest.approx(100)
    assert {r.share_pct for r in rollups.share(fact.where("sku = 'B'"), "system", "usd_amount", 2).collect()} == {0.0}


def test_trend_has_only_top_members(fact):
    got = rollups.trend(fact, "cell", "qty", 2).collect()
    assert {r.cell for r in got} == {"C1", "C3"} and sum(r.qty for r in got) == 75.0


def test_scaled_pair(fact):
    got = {r.factory: r.egp_amount_scaled for r in rollups.scaled_pair(fact, "factory", "qty", "egp_amount", 8).collect()}
    assert got == {"F2": pytest.approx(65.0), "F1": pytest.approx(3 * 65 / 11)}
    zero = rollups.scaled_pair(fact.where("factory = 'F2'"), "factory", "qty", "usd_amount", 8).first()
    assert zero.usd_amount_scaled == 0.0


def test_rollup_and_histogram(fact):
    got = {(r.factory, r.cell, r.depth): r.qty for r in rollups.pair_rollup(fact, "factory", "cell", "qty", 3).collect()}
    assert got[(None, None, 0)] == 85.0 and got[("F2", None, 1)] == 65.0 and ("F1", "C1", 2) not in got
    bins = {r.bin_start: r.members for r in rollups.order_count_histogram(fact, "cell", 2).collect()}
    assert bins == {2: 2, 0: 1}


def test_kpis_and_item_kpis(fact):
    row = rollups.kpis(fact, "cell", ("qty",)).first()
    assert (row["rows"], row.members) == (5, 3) and row.rows_per_member == pytest.approx(5 / 3)
    items = {r.sku: (r.qty, r.orders, r.item_category) for r in rollups.item_kpis(fact).collect()}
    assert items["A"] == (30.0, 2, "Prime")


def test_summary(fact):
    row = rollups.summary(fact).first()
    assert row.overview.total_rows == 5 and row.items.prime_items == 1 and row.dimensions.countries == 3
    assert row.top_performers[0].ranking == "top_countries_by_usd"


def test_search(fact):
    assert {r.sku for r in filters.search_items(fact, "red|^b$").collect()} == {"A", "B", "C"}
    assert [r.sku for r in filters.search_items(fact, "", 2).collect()] == ["A", "B"]


@pytest.mark.parametrize(
    ("spec", "qty"),
    [
        (Filters(), 95.0),
        (Filters(years=(2021,)), 65.0),
        (Filters(period_start="2020-02", period_end="2021-03"), 80.0),
        (Filters(period_start="2020-02"), 95.0),
        (Filters(countries=("EG", "All Countries")), 95.0),
        (Filters(countries=("EG",), systems=("S2",)), 20.0),
        (Filters(factories=("F2",), exclude_systems=("S1",)), 35.0),
        (Filters(category="Prime", equals={"cell": "C1", "nothing": 3}), 10.0),
    ],
)
def test_filters(fact, spec, qty):
    assert filters.apply_filters(fact, spec).agg(F.sum("qty")).first()[0] == qty
    assert filters.apply_filters(fact.drop("year"), spec).agg(F.sum("qty")).first()[0] == qty
