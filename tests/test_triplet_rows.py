"""Moments of triplets are added up in blocks: no pair is a row."""

import numpy as np

from skyloom.functions.sky import real_ylm, ylm_values
from skyloom.operators import paircount
from tests.test_points import frame


def test_pairs_are_no_rows(spark):
    p = np.random.default_rng(3).random((300, 3))
    got = paircount.triplet_poles(frame(spark, p), [0.0, 1.0, 2.0], (0, 2))
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join" not in plan.split("== Physical Plan ==")[1].replace("BroadcastHashJoin", "")
    found = {(r["b1"], r["b2"]): r["zeta_0"] for r in got.collect()}
    s = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    near, far = ((s > 0) & (s <= 1)).sum(axis=1), (s > 1).sum(axis=1)
    assert np.isclose(found[0, 0] * (4 * np.pi) ** 2, (near * near).sum()) and np.isclose(found[0, 1] * (4 * np.pi) ** 2, (near * far).sum())


def test_harmonics_of_arrays(spark):
    u = np.random.default_rng(4).normal(size=(20, 3))
    df = frame(spark, u)
    at = [(e, m) for e in range(5) for m in range(-e, e + 1)]
    found = np.array([list(r)[1:] for r in sorted(df.select("id", *[real_ylm(e, m, df.x, df.y, df.z).alias(f"y{k}") for k, (e, m) in enumerate(at)]).collect())])
    for k, (e, m) in enumerate(at):
        assert np.allclose(found[:, k], ylm_values(e, m, *u.T) * np.ones(20))
