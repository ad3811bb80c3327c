import pytest

from tallycast.config import REQUIRED_RAW_COLUMNS
from tallycast.functions.session import cut_lineage
from tallycast.plans import ingest
from tallycast.sources import orders, sinks, star

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_read_orders(spark, tmp_path, fmt):
    rows = [("SKU-A", "10", "2021-01-05", "1", "2", "3"), ("SKU-B", "-5", "2021-02-05", "1", "2", "3")]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in REQUIRED_RAW_COLUMNS))
    path = str(tmp_path / fmt)
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    writer.format(fmt).save(path)
    got = orders.read_orders(spark, path, fmt)
    assert sorted(map(tuple, got.select(*[f"`{c}`" for c in REQUIRED_RAW_COLUMNS]).collect())) == rows


def test_read_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="no_such"):
        orders.read_orders(spark, str(tmp_path / "no_such"))
    with pytest.raises(ValueError, match="format"):
        orders.read_orders(spark, "x", "xlsx")
    assert orders.read_item_list(spark, str(tmp_path / "absent")).count() == 0


def test_item_lists_and_aliases_from_files(spark, tmp_path):
    spark.createDataFrame([(" a ",), ("A",), (None,)], "code string").write.parquet(str(tmp_path / "std"))
    flags = orders.read_item_lists(spark, str(tmp_path / "std"), str(tmp_path / "absent")).collect()
    assert [tuple(r) for r in flags] == [("A", True, False)]
    table = orders.alias_table(spark, {"S1": ["a", "b"], "S2": []})
    table.write.option("header", True).csv(str(tmp_path / "aliases"))
    got = orders.read_alias_table(spark, str(tmp_path / "aliases"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [("S1", "a", 0), ("S1", "b", 1), ("S2", None, 2)]


def test_ingest_and_save(spark, tmp_path):
    raw = star.order_lines(spark, SF)
    std, prime = star.item_lists(spark, SF)
    flags = orders.item_flags(orders.item_codes(std), orders.item_codes(prime))
    result = ingest.run(raw, flags, orders.alias_table(spark, star.SYSTEM_ALIASES))
    paths = ingest.save(raw, result, str(tmp_path / "out"))
    data = spark.read.parquet(paths["processed_data"])
    assert data.count() == 5992 and "year=1995" in str(list((tmp_path / "out/processed_data").iterdir()))
    assert spark.read.parquet(paths["view_cell"]).count() == 1814
    assert spark.read.json(paths["summary"]).first().overview.total_rows == 5992
    assert spark.read.json(paths["validation"]).first().total_rows == 6000
    assert spark.read.json(paths["fingerprint"]).first()["rows"] == 6000
    with pytest.raises(Exception, match="exists"):
        sinks.write_json(result.validation, paths["validation"])


def test_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", "2021-01", "Historical", 1.5, "Actual")], "series_key string, period string, type string, value double, method string")
    sinks.write_report_csv(df, str(tmp_path / "report"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "report"))
    assert [c for c in back.columns] == df.columns and back.first().value == 1.5
    sinks.write_report_tables(df, df.limit(1), df.limit(1), str(tmp_path / "tables"))
    assert {p.name for p in (tmp_path / "tables").iterdir()} == {"forecast", "metadata", "accuracy_metrics"}


def test_columns_narrow_the_joins(spark):
    plan = star.order_lines(spark, SF, ["Ordered Item", "Booked Date"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_cut_lineage(spark):
    df = spark.range(10).selectExpr("id * 2 AS x")
    assert sorted(r.x for r in cut_lineage(spark, df).collect()) == list(range(0, 20, 2))
