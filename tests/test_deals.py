"""The processed fact takes its lines through one shuffle, by item and deal, for the merge and for the join with items."""

import datetime as dt
import random
from collections import defaultdict

from tallycast.operators import cleaning
from tallycast.plans import ingest

SCHEMA = (
    "`Ordered Item` string, `SO Remaining Qty` double, `Booked Date` date, `SO Line Amount EGP` double, `Shipped Amount [USD]` double,"
    " `Not Shipped Amount [USD]` double, `Country` string, `Order Number` string, `Description` string"
)


def order_lines():
    rng, rows = random.Random(4), []
    for k in range(600):
        item = rng.choice(["hot"] * 5 + [f"i{k % 9}", " I1\t", None, "nan"])
        day = rng.choice([dt.date(2020, 1, 1), dt.date(2020, 5, 2), None]) if k % 3 else dt.date(2021, 1, k % 28 + 1)
        order = rng.choice([None, "", f"o{k % 40}", f"o{k % 40}"])
        rows.append((item, float(k % 5), day, 1.5, 2.0, float(k % 2), rng.choice(["A", "B", None]), order, rng.choice([None, "x", f"text {k % 7}"])))
    return rows * 2


def test_dealt_lines_are_merged_and_described(spark):
    raw = spark.createDataFrame(order_lines(), SCHEMA)
    flags = spark.createDataFrame([("HOT", True, True), ("I1", True, False), ("GONE", True, False)], "sku string, is_standard boolean, is_prime boolean")
    want, texts = defaultdict(float), defaultdict(str)
    for item, qty, day, _, _, _, country, order, text in order_lines():
        sku = (item or "nan").strip().upper()
        if sku != "NAN" and day:
            want[sku, day, country or "Unknown", "Unknown" if order is None else order] += qty
            texts[sku] = max(texts[sku], text or "Unknown")
    df = ingest.process(raw, flags)
    assert df.columns[:2] == ["sku", "order_number"] and "deal" not in df.columns
    got = {(r.sku, r.booked_date.date(), r.country, r.order_number): r for r in df.collect()}
    assert df.count() == len(got) and {k: r.qty for k, r in got.items()} == dict(want)
    for r in got.values():
        assert r.description == texts[r.sku]
        assert r.item_category == {"HOT": "Prime", "I1": "Standard"}.get(r.sku, "Non-Standard")
    hot = cleaning.dealt_lines(cleaning.clean_lines(raw)).where("sku = 'HOT'")
    assert hot.select("deal").distinct().count() == cleaning.DEALS


def test_lines_are_shuffled_once(spark, tmp_path):
    spark.createDataFrame(order_lines(), SCHEMA).write.parquet(str(tmp_path / "lines"))
    raw = spark.read.parquet(str(tmp_path / "lines"))
    flags = spark.createDataFrame([("HOT", True, True)], "sku string, is_standard boolean, is_prime boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ingest.process(raw, flags)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    wide = [line for line in plan.split("\n") if "Exchange" in line and "order_number" in line]
    assert wide == []  # no shuffle by all keys of the merge
    assert sum("hashpartitioning(sku" in line and ", deal#" in line for line in plan.split("\n")) == 2  # lines, and items
