"""Short reaches do not make a block of a few points each."""

import numpy as np
from pyspark.sql import functions as F
from tests.test_boxes import points

from skyloom.operators import spatial


def test_cells_hold_enough_points(spark):
    p = np.random.default_rng(1).random((4000, 3)) * 10
    wide = spatial._wide([points(spark, p)], (0.05,) * 3)
    assert 0.5 <= np.prod(wide) / 1000 * 4000 / spatial.POINTS_A_CELL <= 1.5
    assert spatial._wide([points(spark, p)], (20.0,) * 3) == (20.0,) * 3


def test_a_task_gets_few_rows_however_sparse_its_cells(spark, monkeypatch):
    monkeypatch.setattr(spatial, "ROWS_A_SUM", 2000, raising=False)
    df = points(spark, np.random.default_rng(2).random((4000, 3)) * 20)
    left, right, _ = spatial._dealt(df, df, [], [], (20.0,) * 3, (2.0,) * 3, True, True)
    rows = [{r["at"]: r["count"] for r in d.groupBy(F.spark_partition_id().alias("at")).count().collect()} for d in (left, right)]
    together = {at: sum(r.get(at, 0) for r in rows) for at in {*rows[0], *rows[1]}}
    assert sum(together.values()) == 4000 * 15 and max(together.values()) <= 2 * 2000


def test_points_that_become_many_rows_are_dealt_by_many_tasks(spark, monkeypatch):
    df = points(spark, np.random.default_rng(3).random((4000, 3)) * 20).coalesce(1)
    sides = {}
    for rows in (10**6, 1000):
        monkeypatch.setattr(spatial, "ROWS_A_DEAL", rows, raising=False)
        _, right, _ = spatial._dealt(df, df, [], [], (20.0,) * 3, (2.0,) * 3, True, True)
        sides[rows] = right
    dealt = [{tuple(r) for r in s.drop("own").collect()} for s in sides.values()]
    assert dealt[0] == dealt[1] and len(dealt[0]) == 4000 * 14
    plans = [s._jdf.queryExecution().optimizedPlan().toString() for s in sides.values()]
    assert [p.count("RepartitionByExpression") for p in plans] == [1, 2] and spatial.plan_pairs(df, df, (20.0,) * 3, (2.0,) * 3, True, True).dealers == 60
