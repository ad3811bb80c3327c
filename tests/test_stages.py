"""What keeps the generated classes of a stage below the number that Spark keeps."""

import re

import catalog
import handmade
from test_forecast import frame


def test_both_origins_of_the_closed_report_are_stages_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(catalog, "sparse", lambda *args: frame(spark, {k: handmade.SERIES[k] for k in ("wave", "rare", "n12")}))
    report = catalog.closed_report(spark, "")
    plan = report._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(series_key#\d+, method#\d+, \d+\), REPARTITION_BY_NUM", plan)
    rows = report.where("type = 'Forecast'").groupBy("series_key").agg({"method": "max", "*": "count"}).collect()
    assert {(r[0], r["count(1)"]) for r in rows} == {("wave", 12), ("rare", 12), ("n12", 12)}
    assert {r["max(method)"] for r in rows if r[0] == "n12"} == {"intelligent_growth"}


def test_totals_of_the_closed_report(spark, monkeypatch):
    monkeypatch.setattr(catalog, "sparse", lambda *args: frame(spark, {k: handmade.SERIES[k] for k in ("flat", "n12", "n11")}))
    totals = catalog.report_totals(spark, "")
    assert "REPARTITION_BY_NUM" in str(re.findall(r"method#\d+, \d+\), REPARTITION_BY_NUM", totals._jdf.queryExecution().sparkPlan().toString()))
    got = {r.series_key: r for r in totals.collect()}
    assert {k: r.historical_total for k, r in got.items()} == {"flat": 432.0, "n12": sum(handmade.SERIES["n12"]), "n11": sum(handmade.SERIES["n11"])}
    assert got["n11"].forecast_total is None and got["flat"].forecast_total > 0
