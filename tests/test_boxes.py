"""Unequal boxes, balanced pair joins, several grids in one transform and resampling against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import groups, paircount, power, spatial
from skyloom.operators import mesh as M
from skyloom.operators.box import ratios, three, volume
from skyloom.operators.numbering import running_sum


def cells(spark, *grids, names=("v",)):
    shape = grids[0].shape
    return spark.createDataFrame([(*map(int, i), *[float(g[i]) for g in grids]) for i in np.ndindex(shape)], "ix int, iy int, iz int, " + ", ".join(f"{n} double" for n in names))


def points(spark, p, **more):
    names = [*"xyz", *more]
    rows = [(i, *map(float, r)) for i, r in enumerate(np.column_stack([p, *more.values()]).tolist())]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))


def gaps(p, box):
    d = p[:, None] - p[None]
    return d - box * np.rint(d / box)


def test_sides():
    assert three(2) == (2, 2, 2) and three([1, 2, 3]) == (1, 2, 3) and volume((2, 3, 4)) == 24 and ratios((4.0, 2.0, 1.0)) == (1, 2, 4)
    with pytest.raises(ValueError):
        three((1, 2))


@pytest.mark.parametrize("n", [(4, 6, 5), (3, 2, 8)])
def test_several_grids_in_one_transform(spark, n):
    rng = np.random.default_rng(0)
    a, b = rng.random(n), rng.random(n)
    modes = M.fft(cells(spark, a, b, names=("a", "b")), n, ("a", "b"))
    want = {"a": np.fft.rfftn(a) / a.size, "b": np.fft.rfftn(b) / b.size}
    for r in modes.collect():
        for name, w in want.items():
            assert np.isclose(complex(r[f"re_{name}"], r[f"im_{name}"]), w[r["ix"], r["iy"], r["iz"]])
    for r in M.ifft(modes, n, ("a", "b")).collect():
        assert np.isclose(r["a"], a[r["ix"], r["iy"], r["iz"]]) and np.isclose(r["b"], b[r["ix"], r["iy"], r["iz"]])


def read_waves(v, to):
    """The grid's trigonometric interpolation, cut to the waves that both grids have, on other cells."""
    c = np.fft.fftn(v) / v.size
    out = np.zeros(to, complex)
    at = [np.arange(t) / t for t in to]
    for i in np.ndindex(v.shape):
        k = [x if x <= (n - 1) // 2 else x - n for x, n in zip(i, v.shape)]
        factor = []
        for q, n, t, x in zip(k, v.shape, to, at):
            edge = n % 2 == 0 and abs(q) * 2 == n
            if abs(q) * 2 > min(n, t) or (t < n and t % 2 == 1 and abs(q) * 2 >= t):
                break
            factor.append(np.cos(2 * np.pi * q * x) if edge and t > n else np.exp(2j * np.pi * q * x))
        else:
            out += c[i] * factor[0][:, None, None] * factor[1][None, :, None] * factor[2][None, None, :]
    return out.real


@pytest.mark.parametrize(("n", "to"), [((4, 6, 8), (8, 6, 12)), ((8, 6, 8), (4, 4, 4)), ((5, 4, 6), (7, 8, 5)), ((6, 6, 4), (4, 5, 7)), ((4, 4, 4), (5, 3, 4))])
def test_resampling(spark, n, to):
    v = np.random.default_rng(1).random(n)
    modes = M.fft(cells(spark, v), n)
    found, want = M.resample(modes, n, to), read_waves(v, to)
    got = {(r["ix"], r["iy"], r["iz"]): r["v"] for r in M.ifft(found, to).collect()}
    assert all(np.isclose(got[i], want[i]) for i in np.ndindex(to))
    if all(t > m for m, t in zip(n, to)):
        back = {(r["ix"], r["iy"], r["iz"]): r["v"] for r in M.ifft(M.resample(found, to, n), n).collect()}
        assert all(np.isclose(back[i], v[i]) for i in np.ndindex(n))


def test_a_larger_grid_gives_the_first_one_back(spark):
    n, to = (4, 6, 8), (10, 7, 12)
    v = np.random.default_rng(2).random(n)
    back = M.ifft(M.resample(M.resample(M.fft(cells(spark, v), n), n, to), to, n), n)
    assert all(np.isclose(r["v"], v[r["ix"], r["iy"], r["iz"]]) for r in back.collect())


def test_distinct_wavenumbers_by_gaps(spark):
    n, box = (4, 4, 4), (30.0, 20.0 * (1 + 1e-9), 10.0)
    v = np.random.default_rng(3).random(n)
    got = power.unique_k(power.power_modes(M.fft(cells(spark, v), n), None, volume(box)), n, box).orderBy("bin").collect()
    k = np.meshgrid(*[np.fft.fftfreq(m, 1 / m) * 2 * np.pi / s for m, s in zip(n, box)], indexing="ij")
    k, p = np.sqrt(sum(x * x for x in k)).ravel(), (np.abs(np.fft.fftn(v) / v.size) ** 2 * volume(box)).ravel()
    p[0] = 0
    # 3 nx, 2 ny and nz of these boxes come close to each other, but for 1e-9.
    bins = np.unique(np.round(k / (2 * np.pi / 30) * 1e5))
    assert [r["bin"] for r in got] == list(range(len(bins)))
    for r, b in zip(got, bins):
        own = np.round(k / (2 * np.pi / 30) * 1e5) == b
        assert r["modes"] == own.sum() and np.isclose(r["power"], p[own].mean()) and np.isclose(r["k"], k[own].min())


def test_running_sums(spark):
    df = spark.range(500).select("id", (F.col("id") % 7 == 0).cast("long").alias("a")).repartition(5)
    got = running_sum(df, ["id"], "a", "s").orderBy("id").collect()
    assert [r["s"] for r in got] == np.cumsum(np.arange(500) % 7 == 0).tolist()


def clustered(n=1200, box=(100.0, 80.0, 60.0)):
    p = np.random.default_rng(4).random((n, 3)) * box
    p[: n // 3] = np.array(box) / 2 + np.random.default_rng(5).random((n // 3, 3)) * 2
    return p, np.array(box)


@pytest.mark.parametrize("half", [True, False])
def test_dense_cells_are_cut(spark, monkeypatch, half):
    p, box = clustered()
    monkeypatch.setattr(spatial, "PAIRS_A_TASK", 20_000)
    df = points(spark, p)
    plan = spatial.plan_pairs(df, df, tuple(box), (6.0,) * 3, half)
    assert plan.partitions >= 8 and max(plan.blocks.values()) > 1
    found = spatial.separations(df, df, 6.0, tuple(box), half=half)
    each = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
    assert each[-1] <= 3 * each[len(each) // 2]
    d = np.sqrt((gaps(p, box) ** 2).sum(axis=2)) <= 6.0
    want = {(i, j) for i, j in zip(*np.nonzero(d))}
    got = spatial.radius_pairs(df, df, 6.0, tuple(box), half=half).select("id1", "id2").collect()
    pairs = {(r["id1"], r["id2"]) for r in got}
    assert len(got) == len(pairs)
    assert pairs | {(j, i) for i, j in pairs} | {(i, i) for i in range(len(p))} == want and len(pairs) == ((len(want) - len(p)) // 2 if half else len(want))


@pytest.mark.parametrize("reach", [2.0, 30.0, 60.0])
def test_two_tables_and_few_cells(spark, monkeypatch, reach):
    monkeypatch.setattr(spatial, "PAIRS_A_TASK", 500)
    rng = np.random.default_rng(6)
    for box in ((100.0, 80.0, 50.0), None):
        p, q = rng.random((60, 3)) * 50, rng.random((40, 3)) * 50
        d = p[:, None] - q[None]
        d = d if box is None else d - np.array(box) * np.rint(d / np.array(box))
        want = {(i, j) for i, j in zip(*np.nonzero(np.sqrt((d * d).sum(axis=2)) <= reach))}
        got = spatial.radius_pairs(points(spark, p), points(spark, q), reach, box).collect()
        assert {(r["id1"], r["id2"]) for r in got} == want and len(got) == len(want)
    empty = points(spark, p).where("false")
    assert spatial.radius_pairs(empty, points(spark, q), reach, box).count() == 0


def test_neighbours_of_clustered_points(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PAIRS_A_TASK", 20_000)
    p, box = clustered(400)
    df = points(spark, np.vstack([p, p[:5]]))  # ties at no distance
    d = np.sort(np.sqrt((gaps(np.vstack([p, p[:5]]), box) ** 2).sum(axis=2)), axis=1)
    for k in (1, 8, 40):
        got = {r["id"]: r["r"] for r in spatial.nearest(df, k, tuple(box)).collect()}
        assert np.allclose([got[i] for i in range(405)], d[:, k - 1])
    with pytest.raises(ValueError):
        spatial.nearest(df, 406, tuple(box))
    density = {r["id"]: r["density"] for r in groups.knn_density(df, tuple(box)).collect()}
    assert np.allclose([density[i] for i in range(405)], 1 / d[:, 7] ** 3)


def test_moments_of_triplets(spark):
    rng = np.random.default_rng(7)
    p, w, edges, poles = rng.random((50, 3)) * 10, rng.random(50), [0.0, 1.5, 3.0, 4.0], (0, 1, 3, 5)
    d = gaps(p, np.array([10.0] * 3))
    s = np.sqrt((d * d).sum(axis=2))
    b = np.where(s > 0, np.digitize(s, edges, right=True) - 1, -1)
    want = np.zeros((len(poles), 3, 3))
    for i in range(50):
        own = [j for j in range(50) if 0 <= b[i, j] < 3]
        for j, k in itertools.product(own, own):
            mu = d[i, j] @ d[i, k] / (s[i, j] * s[i, k])
            for e, ell in enumerate(poles):
                want[e, b[i, j], b[i, k]] += w[i] * w[j] * w[k] * (2 * ell + 1) / (4 * np.pi) ** 2 * np.polynomial.legendre.legval(mu, [0] * ell + [1])
    df = points(spark, p, w=w)
    got = paircount.triplet_poles(df, edges, poles, 10.0, weight="w")
    for r in got.collect():
        assert np.allclose([r[f"zeta_{ell}"] for ell in poles], want[:, r["b1"], r["b2"]])
    assert got.count() == 9


def test_fields_that_do_not_belong_together(spark):
    df = spark.createDataFrame([(i, float(i), 1.0, 1.0, 1e-3, 1.0, 0.5, 0.2) for i in range(10)], "id long, x double, y double, z double, NZ double, Weight double, FKPWeight double, Other double")
    one = power.Survey(df, df)
    with pytest.raises(ValueError, match="same catalog"):
        power.survey_poles(one, 4, 10.0, (0.0,) * 3, [0.1, 1.0], second=power.Survey(df, df.where("id > 1"), fkp="Other"))
    with pytest.raises(ValueError, match="same catalog"):
        power.survey_poles(one, 4, 10.0, (0.0,) * 3, [0.1, 1.0], second=power.Survey(df, df, density="Other"))
    with pytest.raises(ValueError, match="5 %"):
        power.fkp_sums(power.Survey(df, df.withColumn("NZ", F.col("NZ") * 2)))
    assert power.survey_sums(one).first()["alpha"] == 1.0
    with pytest.raises(ValueError):
        paircount.box_pairs(df, [1.0, 3.0], (10.0, 10.0, 5.0))
    with pytest.raises(ValueError):
        power.reconstruct(df, df, 4, 10.0, 2.0, 1.0, scheme="none")
