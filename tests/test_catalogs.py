"""Catalogs, mesh objects, tables of bins, redshifts and Poisson numbers by small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.catalog import Catalog, column
from skyloom.functions.cosmology import Cosmology
from skyloom.functions.values import dumps, loads
from skyloom.operators import histograms, mocks, paircount
from skyloom.operators import mesh as M
from skyloom.operators.field import Mesh
from skyloom.operators.numbering import dense_index


def test_lists_of_positions_keep_order_and_repeats(spark):
    c = Catalog.from_arrays(spark, {"v": [10, 11, 12, 13]})
    assert [r["v"] for r in c[[3, 0, 3, -2]].df.orderBy("id").collect()] == [13, 10, 13, 12]
    with pytest.raises(IndexError):
        c[[4]]
    odd = c[c["v"] % 2 == 1].dense().df.orderBy("id").collect()
    assert [(r["id"], r["v"]) for r in odd] == [(0, 11), (1, 13)]


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    for part in (df, df.repartition(7), df.where("x < 0")):
        found = dense_index(part, [F.desc("x")]).orderBy("index").collect()
        assert [r["index"] for r in found] == list(range(len(found)))
        assert [r["x"] for r in found] == sorted((r["x"] for r in found), reverse=True)


def test_mesh_filters_replay_in_order_and_survive_a_save(spark, tmp_path):
    p = np.random.default_rng(7).random((40, 3)) * 10
    c = Catalog.from_arrays(spark, dict(zip("xyz", p.T.tolist(), strict=True)), BoxSize=10.0)
    mesh = c.to_mesh(4)
    at = {(r["ix"], r["iy"], r["iz"]): r["v"] for r in mesh.compute().collect()}
    v = np.array([[[at[i, j, k] for k in range(4)] for j in range(4)] for i in range(4)])
    assert np.isclose(v.mean(), 1)
    kx = np.fft.fftfreq(4, 1 / 4)[:, None, None] * 2 * np.pi / 10
    want = np.fft.irfftn(np.fft.rfftn(v * (np.arange(4) * 2.5)[None, :, None]) * (1 + kx**2), s=v.shape, axes=(0, 1, 2))
    both = mesh.apply(lambda x, y, z: y, "relative", "real").apply(lambda x, y, z: 1 + x * x)
    both.save(str(tmp_path / "m"))
    for df in (both.compute(), Mesh.load(spark, str(tmp_path / "m")).compute()):
        for r in df.collect():
            assert np.isclose(r["v"], want[r["ix"], r["iy"], r["iz"]])
    assert len(mesh.queue) == 0 and both.preview("x").count() == 4
    with pytest.raises(ValueError):
        mesh.apply(lambda x, y, z: x, "relative", "complex")
    assert c.to_mesh(4, interlaced=True, compensated=True).compute("complex").count() == 4 * 4 * 3


def test_bins_by_place_mask_and_name(spark):
    df = spark.createDataFrame([(i, j, 10.0 * i + j) for i in range(3) for j in range(2)], "k int, mu int, p double")
    b = histograms.Bins(df, {"k": [0, 1, 2, 3], "mu": [0, 0.5, 1]})
    assert b.shape == (3, 2) and b.variables == ["p"]
    one = b[-1, 0:2]
    assert one.shape == (1, 2) and sorted(r["p"] for r in one.squeeze().df.collect()) == [20.0, 21.0]
    assert one.squeeze().dims == {"mu": [0, 0.5, 1]}
    assert b.mask("k", [False, True, True]).dims["k"] == [1, 2, 3]
    assert b.rename("k", "q").dims.keys() == {"q", "mu"}
    assert b.with_variable("twice", F.col("p") * 2)[["twice"]].variables == ["twice"] and b["p"].columns == ["k", "mu", "p"]
    assert b.mask("k", [True, False, True]).dims["k"] == [0, 2, 3] and sorted(r["p"] for r in b[::2, 1].df.collect()) == [1.0, 21.0]
    assert b[[0, 2]].df.orderBy("k", "mu").collect() == b.mask("k", [True, False, True]).df.orderBy("k", "mu").collect()
    some = b.where(F.col("p") > 0, F.col("p") < 25)
    assert some.shape == (2, 1) and some.dims == {"k": [1, 2, 3], "mu": [0.5, 1]}
    for wrong in (lambda: b.squeeze(), lambda: b.mask("k", [True]), lambda: b.where(F.col("p") > 99)):
        with pytest.raises(ValueError):
            wrong()
    for wrong in (lambda: b[3], lambda: b[0, 0, 0], lambda: b[::-1], lambda: b[[1, 0]], lambda: b[2:2]):
        with pytest.raises(IndexError):
            wrong()
    with pytest.raises(KeyError):
        b["none"]


def test_distances_in_closed_form_and_back():
    c, z = Cosmology(omega_m=1.0), np.array([0.0, 0.01, 0.7, 3.0, 900.0])
    chi = c.comoving_distance(z)
    assert np.allclose(chi, 2 * 2997.92458 * (1 - 1 / np.sqrt(1 + z)), rtol=1e-10)
    assert np.allclose(c.redshift(chi), z, rtol=1e-7)
    assert np.isnan(c.comoving_distance(2000.0)) and np.isnan(c.redshift(-1.0))


@pytest.mark.parametrize("mean", [0.0, 0.3, 4.9, 12.0, 60.0])
def test_poisson_numbers(spark, mean):
    n = np.array([r[0] for r in spark.range(20000).select(mocks.poisson(F.lit(mean), 5, "id")).collect()])
    assert abs(n.mean() - mean) < 5 * np.sqrt(mean / 20000) + 1e-9
    assert abs(n.var() - mean) < 0.06 * mean + 1e-9
    assert abs((n == 0).mean() - np.exp(-mean)) < 0.02


def test_positions_follow_filters_and_sorts(spark):
    c = Catalog.from_arrays(spark, {"x": [5, 4, 3, 2, 1, 0]})
    x = lambda cat: [r["x"] for r in cat.dense().df.orderBy("id").collect()]
    small = c[c["x"] < 3]
    assert x(small[0:2]) == [2, 1] and x(small[[0, 1]]) == [2, 1] and x(small[-1:]) == [0]
    assert x(c.sort("x")[0:2]) == [0, 1] and x(c.sort("x", reverse=True)[1::2]) == [4, 2, 0]
    assert x(c[::-1]) == [0, 1, 2, 3, 4, 5] and x(c[4:1:-2]) == [1, 3] and x(c[1:4:-1]) == [] and x(c[::-1][0:2]) == [0, 1]
    both = small.concat(small.sort("x"))
    assert [(r["id"], r["x"]) for r in both.df.orderBy("id").collect()] == [(0, 2), (1, 1), (2, 0), (3, 0), (4, 1), (5, 2)]
    assert x(c.sort("x")[["x"]][0:1]) == [0] and x(c.sort("x")[c["x"] > 1][0:2]) == [2, 3]


def test_catalogs_and_their_attributes_survive_a_save(spark, tmp_path):
    attrs = {"BoxSize": np.array([1.0, 2.0, 3.0]), "z": 1 + 2j, "cosmo": Cosmology(omega_m=0.3), "n": np.int64(4), "more": {"a": [np.float32(0.5), None]}}
    c = Catalog.from_arrays(spark, {"x": [3.0, 1.0, 2.0]}, **attrs)
    c.sort("x").save(str(tmp_path / "c"))
    back = Catalog.load(spark, str(tmp_path / "c"))
    assert [r["x"] for r in back[0:2].df.orderBy("id").collect()] == [1.0, 2.0] and back.is_dense
    assert back.attrs["BoxSize"].tolist() == [1, 2, 3] and back.attrs["z"] == 1 + 2j and back.attrs["n"] == 4 and back.attrs["more"] == {"a": [0.5, None]}
    assert back.attrs["cosmo"].comoving_distance(0.5) == attrs["cosmo"].comoving_distance(0.5)
    m = np.array([[1 + 1j, 2], [3, 4j]])
    assert (loads(dumps({"m": m}))["m"] == m).all()


class Shifted(Catalog):
    @column
    def Shift(self):
        return self["x"] + self["Weight"]


def test_derived_columns(spark):
    c = Shifted.from_arrays(spark, {"x": [1.0, 2.0]})
    assert "Shift" in c.columns and [r[0] for r in c[["Shift"]].df.select("Shift").orderBy("Shift").collect()] == [2.0, 3.0]
    assert [r["Shift"] for r in c[c["x"] > 1][["Shift"]].df.collect()] == [3.0] and c.with_column("Shift", 7)["Shift"] is not None
    with pytest.raises(KeyError):
        c["none"]


def test_sources_of_a_count(spark):
    a = Catalog.from_arrays(spark, {"x": [1.0], "y": [1.0], "z": [1.0]}, BoxSize=[4, 4, 2])
    plain = Catalog(a.df)
    assert paircount.check_sources(a) == paircount.check_sources(plain, a) == (4.0, 4.0, 2.0) and paircount.check_sources(plain, None, 3) == (3.0,) * 3
    for wrong in (lambda: paircount.check_sources(plain), lambda: paircount.check_sources(a, None, 5.0), lambda: paircount.check_sources(a, Catalog(a.df, {"BoxSize": 4})), lambda: paircount.check_sources(a, columns=("x", "w"))):
        with pytest.raises(ValueError):
            wrong()


def test_bins_in_text_and_stores(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# k p\n" + "".join(f"{i} {'nan' if i == 2 else i * 10}\n" for i in range(6)))
    b = histograms.Bins.from_plaintext(spark, str(tmp_path / "b.txt"), ["i", "p"], {"k": [0, 1, 2, 3], "mu": [0, 0.5, 1]}, {"n": np.arange(3)})
    assert {(r["k"], r["mu"]): r["i"] for r in b.df.collect()} == {(i // 2, i % 2): i for i in range(6)}
    b.save(str(tmp_path / "s"))
    back = histograms.Bins.load(spark, str(tmp_path / "s"))
    assert back.dims == b.dims and back.attrs["n"].tolist() == [0, 1, 2] and back.df.count() == 6
    with pytest.raises(ValueError):
        histograms.Bins.from_plaintext(spark, str(tmp_path / "b.txt"), ["i", "p"], {"k": [0, 1]})
