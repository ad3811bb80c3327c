import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.forecast import reconcile

SCHEMA = "depth int, series_key string, parent string, h int, yhat double, variance double"


def tree(seed, cells=4, items=6):
    """Rows of a tree of three levels with random forecasts and variances, cells of unequal size."""
    rng = np.random.default_rng(seed)
    rows = [(0, "[]", None)]
    for c in range(cells):
        rows.append((1, f'["c{c}"]', "[]"))
        rows += [(2, f'["c{c}","i{k}"]', f'["c{c}"]') for k in range(1 + c * items // cells)]
    return [(*r, 1, float(rng.uniform(0, 100)), float(rng.uniform(0.1, 30))) for r in rows]


def brute(rows):
    """Generalised least squares with the summing matrix of the tree."""
    keys = [r[1] for r in rows]
    parents = {r[1]: r[2] for r in rows}
    leaves = [k for k in keys if k not in set(parents.values())]

    def above(k):
        while k is not None:
            yield k
            k = parents[k]

    s = np.array([[float(k in set(above(leaf))) for leaf in leaves] for k in keys])
    w = np.diag([1 / r[5] for r in rows])
    y = np.array([r[4] for r in rows])
    return dict(zip(keys, s @ np.linalg.solve(s.T @ w @ s, s.T @ w @ y)))


@pytest.mark.parametrize("seed", range(4))
def test_matches_generalised_least_squares(spark, seed):
    rows = tree(seed)
    got = {r.series_key: r.value for r in reconcile.reconciled(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9)


def test_levels_that_add_up_already_stay(spark):
    rows = [(0, "[]", None, 1, 10.0, 2.0), (1, '["a"]', "[]", 1, 4.0, 1.0), (1, '["b"]', "[]", 1, 6.0, 3.0)]
    got = reconcile.reconciled(spark.createDataFrame(rows, SCHEMA), 1).collect()
    assert all(r.value == pytest.approx(r.yhat, abs=1e-12) for r in got)


def test_missing_parent_makes_trees_of_the_children(spark):
    rows = [r for r in tree(9) if r[0] > 0]
    got = {r.series_key: r for r in reconcile.reconciled(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    for cell in [k for k, r in got.items() if r.depth == 1]:
        part = [(*r[:2], None if r[0] == 1 else r[2], *r[3:]) for r in rows if cell in (r[1], r[2])]
        for k, v in brute(part).items():
            assert got[k].value == pytest.approx(v, rel=1e-9)


def test_bad_input_raises(spark):
    for y, v in ((None, 1.0), (1.0, 0.0), (1.0, None)):
        with pytest.raises(Exception, match="positive variances"):
            reconcile.reconciled(spark.createDataFrame([(0, "[]", None, 1, y, v)], SCHEMA), 0).collect()


def test_empty(spark):
    assert reconcile.reconciled(spark.createDataFrame([], SCHEMA), 2).count() == 0
    none = spark.createDataFrame([], "cell string, sku string, booked_date date, qty double")
    assert reconcile.reconciled_forecasts(none, ("cell", "sku"), "croston").count() == 0


def lines(spark):
    rng = np.random.default_rng(5)
    rows = []
    for cell, sku, first, every in (("A", "x", 0, 1), ("A", "y", 3, 4), ("B", 'q"|', 10, 2), (None, "z", 30, 1), ("B", None, 0, 35)):
        for t in range(first, 36, every):
            rows.append((cell, sku, dt.date(2020 + t // 12, t % 12 + 1, 3), float(rng.integers(1, 50)), 1))
    return spark.createDataFrame(rows, "cell string, sku string, booked_date date, qty double, parent int")


@pytest.mark.parametrize("method,variance", [("exp_smoothing", "naive"), ("croston", "level")])
def test_every_node_and_step_adds_up(spark, method, variance):
    rows = reconcile.reconciled_forecasts(lines(spark), ("cell", "sku"), method, variance=variance, horizon=5).collect()
    assert len(rows) == 5 * (1 + 3 + 5)
    for parent in {r.parent for r in rows} - {None}:
        for h in range(1, 6):
            whole = next(r.value for r in rows if r.series_key == parent and r.h == h)
            parts = sum(r.value for r in rows if r.parent == parent and r.h == h)
            assert whole == pytest.approx(parts, abs=1e-9)


def test_node_series_sum_to_the_total(spark):
    rows = reconcile.node_series(lines(spark), ("cell", "sku"))
    sums = {r.depth: r.s for r in rows.groupBy("depth").agg(F.sum("value").alias("s")).collect()}
    assert sums[0] == sums[1] == sums[2]
    assert rows.where("depth = 2").select("series_key").distinct().count() == 5
    assert rows.where("series_key = '[null]'").count() == 6
