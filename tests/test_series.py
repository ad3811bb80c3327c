import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallycast.functions.periods import ordinal, period_label, period_start, shift
from tallycast.operators import series

LINES = [
    ("A", "S1", "C1", "Prime", dt.datetime(2020, 1, 31, 12), 5.0),
    ("A", "S1", "C1", "Prime", dt.datetime(2020, 1, 1), 2.0),
    ("A", "S2", "C1", "Prime", dt.datetime(2020, 5, 10), 1.0),
    ("B", "S2", "C2", "Standard", dt.datetime(2021, 2, 28), 4.0),
]
SCHEMA = "sku string, system string, cell string, item_category string, booked_date timestamp_ntz, qty double"


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(LINES, SCHEMA)


@pytest.mark.parametrize(("freq", "count"), [("M", 5), ("Q", 2), ("Y", 1), ("W", 19)])
def test_dense_series_have_no_gaps(lines, freq, count):
    dense = series.densify(series.build_series(lines, "item", "qty", freq), freq)
    rows = dense.where("series_key = 'A'").orderBy("t").collect()
    assert [r.t for r in rows] == list(range(count))
    assert sum(r.value for r in rows) == 8.0
    steps = dense.where("series_key = 'A'").select(ordinal(F.col("period_start"), freq).alias("o")).orderBy("o").collect()
    assert [r.o - steps[0].o for r in steps] == list(range(count))
    assert series.densify(dense, freq).count() == dense.count()


@pytest.mark.parametrize(("level", "keys"), [("item", {"A", "B"}), ("system", {"S1", "S2"}), ("cell", {"C1", "C2"}), ("prime", {"Prime"}), ("standard", {"Standard"})])
def test_levels(lines, level, keys):
    got = series.build_series(lines, level, "qty")
    assert {r.series_key for r in got.collect()} == keys


def test_bad_arguments(lines):
    for args in (("country", "qty", "M"), ("item", "price", "M"), ("item", "qty", "D")):
        with pytest.raises(ValueError):
            series.build_series(lines, *args)


def test_periods(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 3, 23),)], "d timestamp_ntz")
    out = {}
    for freq in "YQMW":
        start = period_start(F.col("d"), freq)
        out[freq] = df.select(start, period_label(start, freq), shift(start, F.lit(2), freq)).first()
    assert tuple(out["Y"]) == (dt.date(2021, 1, 1), "2021", dt.date(2023, 1, 1))
    assert tuple(out["Q"]) == (dt.date(2021, 1, 1), "2021Q1", dt.date(2021, 7, 1))
    assert tuple(out["M"]) == (dt.date(2021, 1, 1), "2021-01", dt.date(2021, 3, 1))
    assert tuple(out["W"]) == (dt.date(2020, 12, 28), "2020-12-28/2021-01-03", dt.date(2021, 1, 11))


def test_yearly_totals(lines):
    got = {(r.series_key, r.year): r.value for r in series.yearly_totals(series.build_series(lines, "item", "qty")).collect()}
    assert got == {("A", 2020): 8.0, ("B", 2021): 4.0}


def test_yearly_totals_fill_empty_years(spark):
    rows = [("A", dt.date(2018, 5, 1), 2.0), ("A", dt.date(2021, 1, 1), 3.0), ("B", dt.date(2020, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "series_key string, period_start date, value double")
    got = {(r.series_key, r.year): r.value for r in series.yearly_totals(df).collect()}
    assert got == {("A", 2018): 2.0, ("A", 2019): 0.0, ("A", 2020): 0.0, ("A", 2021): 3.0, ("B", 2020): 1.0}


def test_one_gate_for_status_and_forecast(spark):
    months = [dt.date(2019 + k // 12, 1 + k % 12, 1) for k in range(14)]
    rows = [("zero", d, x) for d, x in zip(months, [5.0, -5.0] * 7, strict=True)] + [("good", d, 1.0) for d in months] + [("short", months[0], 1.0)]
    df = spark.createDataFrame([("item", *r) for r in rows], "level string, series_key string, period_start date, value double")
    ok = {r.series_key for r in series.series_status(df).where("status = 'ok'").collect()}
    assert ok == {r.series_key for r in series.forecastable(series.index_series(df)).collect()} == {"good"}
