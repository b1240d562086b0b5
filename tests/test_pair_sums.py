"""Pair counts are added up in blocks and kept as a small table of bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_boxes import clustered, gaps, points

from skyloom.operators import histograms, paircount, spatial


def counted(df):
    return {(r["r_bin"], r["bin2"]) if "bin2" in df.columns else r["r_bin"]: (r["npairs"], r["wnpairs"], round(r["r"], 9)) for r in df.collect()}


def brute(d, s, w, edges, second=None):
    found = {}
    for k in range(len(edges) - 1):
        for m in [None] if second is None else range(int(second.max()) + 1):
            use = (s >= edges[k]) & (s < edges[k + 1]) & (True if m is None else second == m)
            if use.any():
                found[k if m is None else (k, m)] = (int(use.sum()), float((w * use).sum()), round(float(s[use].mean()), 9))
    return found


@pytest.mark.parametrize("periodic", [True, False])
def test_dense_cells_in_small_blocks(spark, monkeypatch, periodic):
    monkeypatch.setattr(spatial, "PAIRS_A_SUM", 5_000)
    monkeypatch.setattr(spatial, "TILE", 100)
    p, box = clustered(500)
    q, w = p[::3] + 0.25, (np.arange(500) % 4 + 1).astype(float)
    df, other = (points(spark, x).withColumn("w", (F.col("id") % 4 + 1).cast("double")) for x in (p, q))
    edges, sides = [0.5, 1.0, 6.0, 20.0], tuple(box) if periodic else None
    d = gaps(p, box) if periodic else p[:, None] - p[None]
    s, ww = np.sqrt((d * d).sum(axis=2)), w[:, None] * w[None]
    assert counted(paircount.box_pairs(df, edges, sides, weight="w")) == brute(d, s, ww, edges)
    with np.errstate(invalid="ignore", divide="ignore"):
        mu = np.nan_to_num(np.minimum(np.floor(np.abs(d[..., 1]) / s * 4), 3))
    assert counted(paircount.box_pairs(df, edges, sides, mode="2d", los="y", n_mu=4, weight="w")) == brute(d, s, ww, edges, mu)
    e = p[:, None] - q[None]
    e = e - box * np.rint(e / box) if periodic else e
    across, layer = np.sqrt(e[..., 0] ** 2 + e[..., 2] ** 2), np.floor(np.abs(e[..., 1]))
    got = counted(paircount.box_pairs(df, edges, sides, other, "projected", "y", pimax=5.0, weight="w"))
    assert got == brute(e, across, w[:, None] * (np.arange(len(q)) % 4 + 1)[None], edges, np.where(layer < 5, layer, -1))


def test_bins_are_read_and_not_counted_again(spark):
    df = points(spark, clustered(200)[0])
    two = histograms.Bins(paircount.box_pairs(df, [2.0, 6.0, 10.0], None, mode="2d", n_mu=4), {"r_bin": [2.0, 6.0, 10.0], "bin2": [0.0, 0.25, 0.5, 0.75, 1.0]})
    for b in (two, two.sel("nearest", bin2=0.4), two.reindex("bin2", 2), two[::2, [0, 3]]):
        assert b.df.inputFiles() and all("skyloom-" in f for f in b.df.inputFiles())
    none = two.where(F.col("npairs") < 0, or_none=True)
    assert none.df.isEmpty() and none.dims == two.dims


@pytest.mark.parametrize("periodic", [True, False])
def test_counts_without_means_take_tables_whole(spark, monkeypatch, periodic):
    monkeypatch.setattr(spatial, "PAIRS_A_SUM", 5_000)
    monkeypatch.setattr(spatial, "TILE", 100)
    p, box = clustered(400)
    p = np.concatenate([p, np.floor(p[:100])])
    df = points(spark, p).withColumn("w", (F.col("id") % 4 + 1).cast("double"))
    other = points(spark, p[::3] + 0.25).withColumn("w", F.lit(2.0))
    edges, sides = [0.5, 1.0, 6.0, 20.0], tuple(box) if periodic else None
    repeated = df.unionByName(df.where("id < 50").withColumn("x", F.col("x") + 0.7))
    for a, b in ((df, None), (df, other), (repeated, None)):
        want, got = ({r["r_bin"]: (r["npairs"], r["wnpairs"]) for r in paircount.box_pairs(a, edges, sides, b, weight="w", means=m).collect()} for m in (True, False))
        assert got == want and len(got) == 3
    s2 = paircount._least_square(0.1)
    assert np.sqrt(s2) >= 0.1 > np.sqrt(np.nextafter(s2, 0))
