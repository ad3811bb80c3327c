"""Memory of a task stays where it is as the input grows: tasks over lines and series follow the bytes of the input files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallycast.functions.session import input_bytes
from tallycast.operators import series
from tallycast.operators.series import build_series, by_series, index_series, kept_series, least_tasks


@pytest.fixture
def lines(spark, tmp_path):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=17 * k) for k in range(40)]
    rows = [(f"s{k % 7}" if k % 3 else "hot", day, float(k)) for k, day in enumerate(days * 5)] + [(None, days[0], 1.0)]
    spark.createDataFrame(rows, "sku string, booked_date date, qty double").write.parquet(str(tmp_path / "a b"))
    return spark.read.parquet(str(tmp_path / "a b"))


def test_bytes_are_those_of_the_files(spark, lines, tmp_path):
    assert input_bytes(lines) == sum(p.stat().st_size for p in (tmp_path / "a b").glob("*.parquet"))
    assert input_bytes(lines.limit(1).unionByName(lines)) == input_bytes(lines)
    assert input_bytes(spark.range(3)) == 0


def test_more_input_makes_more_tasks_of_series(spark, lines, monkeypatch):
    rows = build_series(lines, "item", "qty")
    few = index_series(rows)
    assert few.rdd.getNumPartitions() == least_tasks(spark)
    monkeypatch.setattr(series, "SERIES_BYTES", input_bytes(lines) // (3 * least_tasks(spark)))
    many = index_series(rows)
    assert many.rdd.getNumPartitions() >= 3 * least_tasks(spark)
    assert kept_series(many).rdd.getNumPartitions() == many.rdd.getNumPartitions()
    assert by_series(rows, 5).rdd.getNumPartitions() == 5
    assert sorted(many.collect(), key=str) == sorted(few.collect(), key=str)


def test_lines_of_large_input_are_spread_before_they_are_summed(spark, lines, monkeypatch):
    here = build_series(lines, "item", "qty")
    assert here._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 0
    monkeypatch.setattr(series, "LINE_BYTES", 1)
    spread = build_series(lines, "item", "qty")
    assert "Exchange hashpartitioning(sku" in spread._jdf.queryExecution().sparkPlan().toString()
    sizes = series.spread_lines(lines, "sku", "booked_date", "qty").rdd.glom().map(len).collect()
    assert len(sizes) == least_tasks(spark) and max(sizes) <= 20
    assert sorted(spread.collect(), key=str) == sorted(here.collect(), key=str)


def test_sums_of_large_input_are_not_merged_into_few_tasks(spark, lines, monkeypatch):
    monkeypatch.setattr(series, "LINE_BYTES", 1)
    rows = build_series(lines, "item", "qty")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # Lines are dealt, their sums are dealt; nothing is left for Spark to merge by its bytes.
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan
    assert rows.rdd.getNumPartitions() == series.series_tasks(lines)


@pytest.mark.parametrize("level", ["item", "prime"])
@pytest.mark.parametrize("freq", ["M", "Y", "W"])
def test_sums_in_deals_are_the_sums(spark, lines, tmp_path, monkeypatch, freq, level):
    odd = lines.withColumn("item_category", F.when(F.col("qty") > 3, "Prime")).withColumn(
        "qty", F.when(F.col("qty") == 5, None).when(F.col("qty") == 7, -0.1).otherwise(F.col("qty") + 1e-7)
    )
    odd.unionAll(odd).write.parquet(str(tmp_path / "odd"))
    odd = spark.read.parquet(str(tmp_path / "odd"))
    here = build_series(odd, level, "qty", freq).collect()
    monkeypatch.setattr(series, "LINE_BYTES", 1)
    assert sorted(build_series(odd, level, "qty", freq).collect(), key=str) == sorted(here, key=str)
