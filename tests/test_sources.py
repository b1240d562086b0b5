import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.sources import files


def test_csv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n1.0  2.5 3\n\n4.0\t5.5 6")
    df = files.read_csv(spark, str(tmp_path / "a.txt"), ["a", "b", "c"], {"c": "int"}, ["a", "c"])
    assert sorted(map(tuple, df.collect())) == [(1.0, 3), (4.0, 6)]
    (tmp_path / "b.txt").write_text("1, 2\n3, 4\n")
    assert files.read_csv(spark, str(tmp_path / "b.txt"), ["a", "b"], whitespace=False).agg(F.sum("b")).first()[0] == 6
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "a.txt"), ["a"], usecols=["z"])


def test_binary_stack(spark, tmp_path):
    rng = np.random.default_rng(0)
    pos, mass = rng.random((40, 3)), rng.random(40)
    for k in range(2):
        own = slice(20 * k, 20 * k + 20)
        (tmp_path / f"p{k}.bin").write_bytes(b"head" + pos[own].tobytes() + mass[own].tobytes())
    fields = [("Position", "<f8", 3), ("Mass", "<f8", 1)]
    rows = files.with_ids(files.read_binary(spark, f"{tmp_path}/*.bin", fields, header=4)).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(40))
    assert np.array_equal([r["Position"] for r in rows], pos) and np.array_equal([r["Mass"] for r in rows], mass)
    with pytest.raises(Exception, match="whole number of rows"):
        files.read_binary(spark, f"{tmp_path}/p0.bin", fields, header=5).count()


def test_tpm(spark, tmp_path):
    p = np.arange(15, dtype="<f4")
    (tmp_path / "t").write_bytes(bytes(28) + p.tobytes() + (-p).tobytes() + np.arange(5, dtype="<u8").tobytes())
    rows = files.read_tpm(spark, str(tmp_path / "t")).orderBy("row").collect()
    assert [r["ID"] for r in rows] == list(range(5)) and rows[1]["Velocity"] == [-3.0, -4.0, -5.0]


def test_gadget(spark, tmp_path):
    record = lambda b: np.int32(len(b)).tobytes() + b + np.int32(len(b)).tobytes()
    head = np.array([2, 3, 0, 0, 0, 0], "<u4").tobytes() + np.array([0, 7.0, 0, 0, 0, 0], "<f8").tobytes()
    pos = np.arange(15, dtype="<f4")
    data = record(head.ljust(256, b"\0")) + record(pos.tobytes()) + record((2 * pos).tobytes()) + record(np.arange(5, dtype="<u4").tobytes()) + record(np.array([1, 2], "<f4").tobytes())
    (tmp_path / "g").write_bytes(data)
    dark = files.read_gadget1(spark, str(tmp_path / "g"), 1, ("Position", "ID", "Mass")).orderBy("row").collect()
    assert [(r["Position"][0], r["ID"], r["Mass"]) for r in dark] == [(6.0, 2, 7.0), (9.0, 3, 7.0), (12.0, 4, 7.0)]
    gas = files.read_gadget1(spark, str(tmp_path / "g"), 0, ("Mass",)).orderBy("row").collect()
    assert [r["Mass"] for r in gas] == [1.0, 2.0]


def test_fits(spark, tmp_path):
    def block(cards):
        return "".join(f"{k:<8}= {v}".ljust(80) for k, v in cards) .encode() + b"END".ljust(80)

    fill = lambda b: b.ljust(-(-len(b) // 2880) * 2880, b" ")
    rows = np.zeros(4, [("Position", ">f8", (3,)), ("Mass", ">f4")])
    rows["Position"], rows["Mass"] = np.arange(12).reshape(4, 3), np.arange(4)
    table = [("XTENSION", "'BINTABLE'"), ("BITPIX", "8"), ("NAXIS", "2"), ("NAXIS1", str(rows.itemsize)), ("NAXIS2", "4"), ("PCOUNT", "0"), ("GCOUNT", "1"), ("TFIELDS", "2"), ("TTYPE1", "'Position'"), ("TFORM1", "'3D'"), ("TTYPE2", "'Mass'"), ("TFORM2", "'E'")]
    (tmp_path / "f.fits").write_bytes(fill(block([("SIMPLE", "T"), ("BITPIX", "8"), ("NAXIS", "0")])) + fill(block(table)) + fill(rows.tobytes()))
    fields = [("Position", ">f8", 3), ("Mass", ">f4", 1)]
    got = files.read_fits(spark, str(tmp_path / "f.fits"), fields).orderBy("row").collect()
    assert [r["Mass"] for r in got] == [0, 1, 2, 3] and got[2]["Position"] == [6, 7, 8]
    with pytest.raises(Exception, match="not a binary table"):
        files.read_fits(spark, str(tmp_path / "f.fits"), fields, ext=0).count()


def test_as_array(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3)], "a double, b double, c int")
    assert df.select(files.as_array(df, ["a", "b"])).first()[0] == [1.0, 2.0]
    with pytest.raises(ValueError):
        files.as_array(df, ["a", "c"])
