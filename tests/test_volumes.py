"""Sub-volumes against a loop over boxes and images."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_boxes import points

from skyloom.operators import volumes


@pytest.mark.parametrize(("margin", "most"), [(0.0, 10), (2.0, 30), (7.0, 5), (10.0, 1000)])
def test_points_and_ghosts(spark, margin, most):
    box = np.array([40.0, 20.0, 25.0])
    p = np.vstack([np.random.default_rng(0).random((150, 3)) * box, np.random.default_rng(1).random((80, 3)) * 2 + 8, [[0, 0, 0], [40 - 1e-9, 0, 12.5], [41.0, -1.0, 30.0]]])
    tree = volumes.cut(points(spark, p), box.tolist(), most, margin)
    got = volumes.sub_volumes(points(spark, p, w=np.arange(len(p))), box.tolist(), most, margin, ["w"], tree).collect()
    inside, want = p % box, set()
    for number, _, _, lo, hi in tree.bounds(tuple(box)):
        for step in itertools.product((-1, 0, 1), repeat=3):
            at = inside + np.array(step) * box
            near = ((at + margin >= lo) & (at - margin < hi)).all(axis=1)
            own = ((at >= lo) & (at < hi)).all(axis=1)
            want |= {(number, not own[i], i, *np.round(at[i], 6)) for i in np.flatnonzero(near if margin else own)}
    assert {(r["volume"], r["ghost"], r["id"], *np.round([r["x"], r["y"], r["z"]], 6)) for r in got} == want and len(got) == len(want)
    assert sorted(r["id"] for r in got if not r["ghost"]) == list(range(len(p))) and all(r["w"] == r["id"] for r in got)
    held = [sum(1 for r in got if r["volume"] == v and not r["ghost"]) for v in range(len(tree.boxes))]
    finest = [level == tree.levels for level, _ in tree.boxes]
    assert all(n and (n <= most or deep) for n, deep in zip(held, finest))


def test_boxes_lie_along_the_curve_and_fill_what_the_sample_missed(spark, monkeypatch):
    p = np.random.default_rng(2).random((3000, 3)) * 10
    p[:1500] = p[:1500] / 8
    df = points(spark, p)
    whole = volumes.cut(df, 10.0, 40)
    starts = [place << (3 * (whole.levels - level)) for level, place in whole.boxes]
    assert starts == sorted(starts)
    monkeypatch.setattr(volumes, "SAMPLE", 300)
    tree = volumes.cut(df, 10.0, 200)
    assert sum(8.0 ** (tree.levels - level) for level, _ in tree.boxes) == 8.0**tree.levels
    found = volumes.sub_volumes(df, 10.0, 200, tree=tree)
    assert found.count() == 3000 and found.select("id").distinct().count() == 3000
    # Volumes stay whole, and each task has a range of them.
    seen = found.groupBy(F.spark_partition_id().alias("t")).agg(F.min("volume").alias("a"), F.max("volume").alias("b")).orderBy("a").collect()
    assert all(x["b"] < y["a"] for x, y in zip(seen, seen[1:]))


def test_no_points_and_wide_margins(spark):
    none = points(spark, np.zeros((1, 3))).where("false")
    assert volumes.sub_volumes(none, 10.0, 5, 1.0).count() == 0
    with pytest.raises(ValueError):
        volumes.cut(none, 10.0, 5, 11.0)
