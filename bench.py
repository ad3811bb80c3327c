"""Time the headline queries and print one JSON line.

Every query is planned, run to the end and its rows counted by writing to the noop sink.
"""

from __future__ import annotations

import json
import os
import time

import catalog
from tallycast.functions.session import get_session

HEADLINE = (
    "clean_lines",
    "merge_splits",
    "processed_fact",
    "view_monthly_sku",
    "view_country",
    "top_performers",
    "kpi_executive",
    "trend_topk_cell",
    "item_kpis",
    "quality_duplicates",
    "quality_split_groups",
    "quality_rules",
    "validation_long",
    "dense_item_month",
    "demand_profile_item",
    "growth_profile_item",
    "fc_croston",
    "fc_exp_smoothing",
    "fc_intelligent_growth",
    "fc_advanced_ensemble_closed",
    "fc_finished_item",
    "fc_holt_winters",
    "backtest_metrics_item",
    "forecast_report_closed",
    "rolling_origins",
    "fc_meta_learner",
    "forecast_report",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["view_system"](spark, sf).write.format("noop").mode("overwrite").save()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    times = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
