"""Tasks over series: their number is given, not derived from the few bytes of the series."""

from test_origins import frame, long_series

from tallycast.operators import series
from tallycast.operators.series import by_series, kept_series


def wanted(spark):
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), series.SERIES_PARTITIONS * spark.sparkContext.defaultParallelism)


def weekly(n):
    return {f"s{k}": long_series()["weekly"][k : k + 30 + k] for k in range(n)}


def test_few_bytes_of_series_are_not_merged_into_few_tasks(spark):
    rows = frame(spark, weekly(8))
    assert by_series(rows).rdd.getNumPartitions() == wanted(spark)
    kept = kept_series(rows)
    assert kept.rdd.getNumPartitions() == wanted(spark)
    assert sorted(kept.collect()) == sorted(rows.collect())
