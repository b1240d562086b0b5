"""Groups, neighbours, grids and bins against brute force in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import groups, histograms, mocks, paircount, power
from skyloom.operators import mesh as M


def frame(spark, p, **more):
    cols = {"id": range(len(p)), **{a: p[:, i].tolist() for i, a in enumerate("xyz")}, **more}
    return spark.createDataFrame([tuple(float(v) if k != "id" else int(v) for k, v in zip(cols, r, strict=True)) for r in zip(*cols.values(), strict=True)], ", ".join(f"{k} {'long' if k == 'id' else 'double'}" for k in cols))


def gaps(p, box):
    d = np.abs(p[:, None] - p[None])
    return np.sqrt((np.minimum(d, box - d) ** 2).sum(axis=2))


def test_lattice_without_merging(spark):
    g = np.stack(np.meshgrid(*[np.arange(4.0)] * 3, indexing="ij"), -1).reshape(-1, 3)
    found = groups.fof(frame(spark, g), 0.9, 0, 4.0).collect()
    assert sorted(r["label"] for r in found) == list(range(1, 65))
    assert {r["label"] for r in groups.fof(frame(spark, g), 1.1, 3, 4.0).collect()} == {1}


def test_fof_against_brute_force(spark):
    p = np.random.default_rng(1).random((150, 3)) * 10
    near = gaps(p, 10.0) <= 0.9
    low = np.arange(150)
    while ((new := np.where(near, low[None, :], 150).min(axis=1)) != low).any():
        low = new
    found = {r["id"]: r["label"] for r in groups.fof(frame(spark, p), 0.9, 1, 10.0).collect()}
    for i in range(150):
        assert (found[i] > 0) == ((low == low[i]).sum() > 1)
        for j in range(i):
            assert not (found[i] and found[j]) or (found[i] == found[j]) == (low[i] == low[j])


def test_knn_density(spark):
    p = np.random.default_rng(2).random((200, 3)) * 10
    d = np.sort(gaps(p, 10.0), axis=1)[:, 7]
    found = {r["id"]: r["density"] for r in groups.knn_density(frame(spark, p), 10.0).collect()}
    assert np.allclose([found[i] for i in range(200)], 1 / d**3)


def test_cylindrical_groups_are_greedy(spark):
    rng = np.random.default_rng(3)
    p, mass = rng.random((120, 3)) * 20, rng.random(120)
    found = {r["id"]: r for r in groups.cylindrical_groups(frame(spark, p, m=mass.tolist()), "m", 2.0, 3.0, 20.0).collect()}
    d = p[:, None] - p[None]
    d = (d + 10) % 20 - 10
    near = (np.hypot(d[..., 0], d[..., 1]) <= 2) & (np.abs(d[..., 2]) <= 3)
    kind = {}
    for i in np.argsort(-mass):
        kind[i] = int(any(kind.get(j) == 0 and near[i, j] for j in range(120)))
    assert {i: found[i]["cgm_type"] for i in range(120)} == kind
    assert sum(r["num_cgm_sats"] for r in found.values()) == sum(kind.values())


def test_pairs(spark):
    p = np.random.default_rng(4).random((200, 3)) * 10
    d = gaps(p, 10.0)
    got = {r["r_bin"]: r["npairs"] for r in paircount.box_pairs(frame(spark, p).withColumn("w", F.lit(1.0)), [0.5, 1.0, 2.0], 10.0, weight="w").collect()}
    assert [got[0], got[1]] == np.histogram(d, [0.5, 1.0, 2.0])[0].tolist()


@pytest.mark.parametrize("n", [4, 6])
def test_transform_and_back(spark, n):
    v = np.random.default_rng(5).random((n, n, n))
    cells = spark.createDataFrame([(*map(int, i), float(v[i])) for i in np.ndindex(v.shape)], "ix int, iy int, iz int, v double")
    modes = M.fft(cells, n)
    want = np.fft.rfftn(v) / n**3
    for r in modes.collect():
        assert np.isclose(complex(r["re"], r["im"]), want[r["ix"], r["iy"], r["iz"]])
    for r in M.ifft(modes, n).collect():
        assert np.isclose(r["v"], v[r["ix"], r["iy"], r["iz"]])


def test_modes_on_edges_are_in_the_bin_above(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0)], "ix int, iy int, iz int, v double")
    p = power.power_modes(M.fft(cells, 8), None, 1.0)
    assert {r["k_bin"]: r["modes"] for r in power.bin_modes(p, 8, 1.0, power.k_edges(8, 1.0)).collect()}[1] == 6 + 12 + 8


def test_uniform_mock_does_not_depend_on_partitions(spark):
    a = mocks.uniform_catalog(spark, 1e-3, 50.0, 3)
    assert a.exceptAll(mocks.uniform_catalog(spark, 1e-3, 50.0, 3).repartition(7)).isEmpty()
    with pytest.raises(ValueError):
        mocks.random_catalog(spark, 0)


def test_bins(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), 2) for i in range(6)], "k int, power double, modes long")
    b = histograms.Bins(df, {"k": [0.0, 1, 2, 3, 4, 5, 6]}, {"n": 1})
    half = b.reindex("k", 2, "modes")
    assert [(r["k"], r["power"], r["modes"]) for r in half.df.orderBy("k").collect()] == [(0, 0.5, 4), (1, 2.5, 4), (2, 4.5, 4)]
    with pytest.raises(ValueError):
        b.reindex("k", 4)
    with pytest.raises(ValueError):
        b.sel(k=0.5)
    b.to_json(str(tmp_path / "b.json"))
    back = histograms.Bins.from_json(spark, str(tmp_path / "b.json"))
    assert back.df.exceptAll(df).isEmpty() and back.attrs == {"n": 1} and back.dims == b.dims


@pytest.mark.parametrize("axes", ["x", "zx", "xyz"])
def test_projected_power(spark, axes):
    n, box = 4, 10.0
    v = np.random.default_rng(6).random((n, n, n))
    cells = spark.createDataFrame([(*map(int, i), float(v[i])) for i in np.ndindex(v.shape)], "ix int, iy int, iz int, v double")
    grid = v.sum(axis=tuple(i for i in range(3) if "xyz"[i] not in axes))
    grid = grid.T if axes == "zx" else grid
    p = np.abs(np.fft.fftn(grid) / grid.size) ** 2 * box ** len(axes)
    p[(0,) * p.ndim] = 0
    k = np.sqrt(sum(x**2 for x in np.meshgrid(*[np.fft.fftfreq(n, 1 / n)] * p.ndim, indexing="ij")))
    # Every mode of the whole space once, which is what counting half of them twice comes to.
    found = {r["k_bin"]: r for r in power.projected_power(cells, n, box, axes=axes).collect()}
    for i in range(2):
        use = (k >= i) & (k < i + 1)
        assert found[i]["modes"] == use.sum() and np.isclose(found[i]["power"], p[use].mean())


@pytest.mark.parametrize("in_task", [True, False])
def test_fiber_collisions_are_greedy(spark, monkeypatch, in_task):
    if not in_task:
        monkeypatch.setattr(groups, "LINKS_A_TASK", 0)
    rng = np.random.default_rng(8)
    ra, dec = rng.random(160) * 3, rng.random(160) * 3
    df = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec, strict=True))], "id long, ra double, dec double")
    found = {r["id"]: r for r in groups.fiber_collisions(df, 0.25, 5).collect()}
    key = {r["id"]: r["k"] for r in df.select("id", F.xxhash64("id", F.lit(5)).alias("k")).collect()}
    a, d = np.radians(ra), np.radians(dec)
    p = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], 1)
    gap = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    near = (gap <= 2 * np.sin(np.radians(0.25) / 2)) & ~np.eye(160, dtype=bool)
    left = np.ones(160, bool)
    # Groups do not touch each other, so one order over all of them decides each group alike.
    while (n := (near & left).sum(axis=1) * left).any():
        most = np.flatnonzero(n == n.max())
        left[min(most, key=lambda i: (n[near[i] & left].sum(), key[i]))] = False
    assert {i for i, r in found.items() if r["collided"]} == set(np.flatnonzero(~left))
    for i, r in found.items():
        if r["collided"]:
            same = [j for j in np.flatnonzero(left) if found[j]["label"] == r["label"]]
            assert r["neighbor_id"] == min(same, key=lambda j: gap[i, j])
        else:
            assert r["neighbor_id"] is None
