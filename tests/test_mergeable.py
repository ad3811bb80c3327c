import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from tallycast.operators import mergeable, rollups

SCHEMA = "sku string, country string, cell string, period_month date, qty double, usd_amount double"
MEASURES, DIMS = ("qty", "usd_amount"), ("country", "cell")


def lines(spark, start, stop, months):
    rows = spark.range(start, stop)
    month = F.element_at(F.array(*[F.lit(dt.date(2024, m, 1)) for m in months]), (F.col("id") % len(months) + 1).cast("int"))
    return rows.select(
        F.when(F.col("id") % 97 != 0, F.concat(F.lit("P"), (F.col("id") * 7919 % 9001).cast("string"))).alias("sku"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("C"), (F.col("id") % 3).cast("string"))).alias("country"),
        F.concat(F.lit("Z"), (F.col("id") % 2).cast("string")).alias("cell"),
        month.alias("period_month"),
        F.when(F.col("id") % 13 != 0, F.col("id") * 0.1).alias("qty"),
        (F.col("id") * 1.000001 - 700).alias("usd_amount"),
    )


def table(df):
    return sorted((tuple(str(x) for x in r) for r in mergeable.shown(df, MEASURES).collect()))


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_batches_equal_a_rebuild_and_touch_their_months_only(spark, tmp_path):
    path = str(tmp_path / "states")
    parts = [lines(spark, 0, 20000, (1, 2, 3)), lines(spark, 20000, 26000, (4,)), lines(spark, 26000, 27000, (2, 5))]
    kept = {}
    for k, part in enumerate(parts):
        mergeable.add_batch(part, path, f"b{k}", DIMS, MEASURES)
        now = files(path)
        assert kept.items() <= now.items()
        kept = now
    assert {Path(f).parent.parent.name for f in kept if "batch=b2" in f} == {"period_month=2024-02-01", "period_month=2024-05-01"}
    whole = mergeable.states(parts[0].union(parts[1]).union(parts[2]), DIMS, MEASURES)
    keys = (*DIMS, "period_month")
    assert table(mergeable.read_states(spark, path, DIMS, MEASURES)) == table(mergeable.merged(whole, keys, MEASURES))
    mergeable.add_batch(parts[2], path, "b2", DIMS, MEASURES)  # the same batch once more
    assert table(mergeable.read_states(spark, path, DIMS, MEASURES)) == table(mergeable.merged(whole, keys, MEASURES))


def test_roll_up_agrees_with_the_lines(spark):
    df = lines(spark, 0, 60000, (1, 2, 3, 4, 5, 6))
    rows = mergeable.shown(mergeable.merged(mergeable.states(df, DIMS, MEASURES), ("country",), MEASURES), MEASURES)
    got = {r.country: r for r in rows.collect()}
    want = {r.country: r for r in df.groupBy("country").agg(
        rollups.exact_sum("qty").alias("qty"), F.countDistinct("sku").alias("items"), F.count(F.lit(1)).alias("n_lines")
    ).collect()}
    assert got.keys() == want.keys() and None in got
    for k, w in want.items():
        assert got[k].qty == w.qty and got[k].n_lines == w.n_lines
        assert w.items > 3000 and abs(got[k]["items"] - w["items"]) <= mergeable.items_bound() * w["items"]


def test_empty_and_null(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert mergeable.merged(mergeable.states(none, DIMS, MEASURES), ("country",), MEASURES).count() == 0
    one = spark.createDataFrame([(None, None, None, dt.date(2024, 1, 1), None, None)], SCHEMA)
    r = mergeable.shown(mergeable.states(one, DIMS, MEASURES), MEASURES).first()
    assert (r.n_lines, r.qty, r["items"], r.country) == (1, 0.0, 0, None)
