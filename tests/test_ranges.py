"""Files by ranges of rows: many tasks for a file, the bytes that are read, slices of stacks, formats of one's own."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.sources import files, ranges
from skyloom.sources.ranges import Block, FitsTable, FlatBinary, Format, Gadget1, Layout, plan_ranges, read_ranges

FIELDS = (("Position", "<f8", 3), ("Mass", "<f4", 1), ("ID", "<i4", 1))


def write(path, n, first=0, head=b""):
    at = np.arange(first, first + n)
    path.write_bytes(head + np.stack([at, at + 0.5, -at], 1).astype("<f8").tobytes() + (at * 2).astype("<f4").tobytes() + at.astype("<i4").tobytes())


@pytest.fixture
def stack(tmp_path):
    sizes = [70, 0, 13, 50]
    for k, n in enumerate(sizes):
        write(tmp_path / f"part{k}.bin", n, sum(sizes[:k]), b"head")
    (tmp_path / "_other.bin").write_bytes(b"no part of it")
    return f"{tmp_path}/part*.bin"


@pytest.mark.parametrize("cut", [(None, None, None), (3, 100, 7), (-20, None, 3), (65, -40, 2), (69, 72, None), (200, None, None), (10, 10, 1), (None, None, 60)])
def test_slices_of_a_stack(spark, stack, cut):
    got = read_ranges(spark, FlatBinary(FIELDS, 4), stack, None, *cut, rows_per_task=16).orderBy("row_id").collect()
    want = np.arange(133)[slice(*cut)]
    assert [r["ID"] for r in got] == want.tolist() and [r["row_id"] for r in got] == list(range(len(want)))
    assert [r["Mass"] for r in got] == (want * 2).tolist() and [r["Position"] for r in got] == [[float(i), i + 0.5, float(-i)] for i in want]
    with pytest.raises(ValueError, match="positive"):
        plan_ranges([], step=-1)


def test_one_file_is_many_tasks_and_unread_columns_are_not_opened(spark, stack, tmp_path):
    df = read_ranges(spark, FlatBinary(FIELDS, 4), f"{tmp_path}/part0.bin", ["Mass"], rows_per_task=16)
    assert df.columns == ["id", "file", "row", "Mass"] and df.rdd.getNumPartitions() == 5
    seen, data = [], (tmp_path / "part0.bin").read_bytes()

    def read(offset, length):
        seen.append((offset, length))
        return data[offset : offset + length]

    layout = FlatBinary(FIELDS, 4).layout(len(data), read)
    part = plan_ranges([("f", layout)], 20, 36)[0]
    batch = pa.Table.from_batches(part.batches(["Mass"], read, ranges.arrow_schema(layout, ["Mass"])))
    assert batch["Mass"].to_pylist() == [2.0 * i for i in range(20, 36)]
    assert seen == [(4 + 70 * 24 + 20 * 4, 16 * 4)]


def test_offsets_sizes_and_errors(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"0123" + np.arange(5, dtype="<i4").tobytes() + b"gap" + np.arange(5, dtype="<f4").tobytes())
    got = files.read_binary(spark, str(tmp_path / "x"), [("a", "<i4", 1), ("b", "<f4", 1)], size=5, offsets={"a": 4, "b": 27}).orderBy("id").collect()
    assert [(r["a"], r["b"]) for r in got] == [(i, float(i)) for i in range(5)]
    for wrong in (FlatBinary((("a", "<i4", 1),), 1), FlatBinary((("a", "<i4", 1),), 0, 100)):
        with pytest.raises(Exception, match="whole number of rows"):
            read_ranges(spark, wrong, str(tmp_path / "x")).count()
    with pytest.raises(Exception, match="no such columns"):
        read_ranges(spark, FlatBinary(FIELDS, rows=1), str(tmp_path / "x"), ["none"]).count()
    with pytest.raises(Exception, match="none.bin"):
        read_ranges(spark, FlatBinary(FIELDS), f"{tmp_path}/none.bin").count()


class Pairs(Format):
    """Rows of two numbers behind a count."""

    def layout(self, size, read):
        n = int(np.frombuffer(read(0, 8), "<i8")[0])
        return Layout(n, {"a": Block("<i4", 1, 8, 12), "b": Block("<f8", 1, 12, 12, scale=2.0, zero=1.0)})


def test_a_format_of_ones_own(spark, tmp_path):
    rows = np.zeros(9, [("a", "<i4"), ("b", "<f8")])
    rows["a"], rows["b"] = np.arange(9), np.arange(9) / 4
    (tmp_path / "p").write_bytes(np.int64(9).tobytes() + rows.tobytes())
    Pairs.__module__ = "__main__"  # tasks do not import tests
    ranges.register_format(spark, "pairs", Pairs())
    got = spark.read.format("pairs").option("columns", "b, a").option("start", 1).option("step", 3).option("rows_per_task", 2).load(str(tmp_path / "p")).orderBy("id").collect()
    assert [(r["b"], r["a"], r["row"]) for r in got] == [(1 + i / 2, i, i) for i in (1, 4, 7)]


def test_fits_columns_are_found(spark, tmp_path):
    card = lambda k, v: f"{k:<8}= {v}".ljust(80)
    fill = lambda b: b.ljust(-(-len(b) // 2880) * 2880, b" ")
    rows = np.zeros(4, [("name", "S3"), ("flag", "S1"), ("x", ">i2"), ("u", ">i4"), ("p", ">f4", (2,))])
    rows["x"], rows["u"], rows["p"] = [1, 2, 3, 4], np.arange(4) - 2**31, np.arange(8).reshape(4, 2)
    cards = [("XTENSION", "'BINTABLE'"), ("BITPIX", "8"), ("NAXIS", "2"), ("NAXIS1", str(rows.itemsize)), ("NAXIS2", "4"), ("PCOUNT", "0"), ("GCOUNT", "1"), ("TFIELDS", "5")]
    for k, (name, form) in enumerate([("name", "3A"), ("flag", "L"), ("x", "I"), ("u", "J"), ("p", "2E")], 1):
        cards += [(f"TTYPE{k}", f"'{name}'"), (f"TFORM{k}", f"'{form}'")]
    cards += [("TSCAL3", "0.5"), ("TZERO3", "10"), ("TZERO4", "2147483648")]
    image = "".join(card(*c) for c in [("SIMPLE", "T"), ("BITPIX", "16"), ("NAXIS", "1"), ("NAXIS1", "5")]) + "END".ljust(80)
    (tmp_path / "t.fits").write_bytes(fill(image.encode()) + fill(bytes(10)) + fill(("".join(card(*c) for c in cards) + "END".ljust(80)).encode()) + fill(rows.tobytes()))
    got = files.read_fits(spark, str(tmp_path / "t.fits"), rows_per_task=1)
    assert dict(got.dtypes) == {"id": "bigint", "file": "string", "row": "bigint", "x": "double", "u": "bigint", "p": "array<float>"}
    assert [(r["x"], r["u"], r["p"]) for r in got.orderBy("id").collect()] == [(10 + (i + 1) / 2, i, [2.0 * i, 2.0 * i + 1]) for i in range(4)]
    with pytest.raises(Exception, match="no binary table"):
        read_ranges(spark, FitsTable(5), str(tmp_path / "t.fits")).count()


def test_snapshot_blocks_by_ranges(spark, tmp_path):
    record = lambda b: np.int32(len(b)).tobytes() + b + np.int32(len(b)).tobytes()
    head = np.array([20, 30, 0, 0, 5, 0], "<u4").tobytes() + np.array([0, 7.0, 0, 0, 0, 0], "<f8").tobytes()
    pos = np.arange(165, dtype="<f8")
    (tmp_path / "g").write_bytes(record(head.ljust(256, b"\0")) + record(pos.tobytes()) + record(pos.astype("<f4").tobytes()) + record(np.arange(55, dtype="<u8").tobytes()) + record(np.arange(25, dtype="<f4").tobytes()) + record(np.arange(20, dtype="<f4").tobytes()))
    star = files.read_gadget1(spark, str(tmp_path / "g"), 4, ("ID", "Mass", "Position"), start=1, rows_per_task=2).orderBy("row_id").collect()
    assert [(r["ID"], r["Mass"], r["Position"][0]) for r in star] == [(50 + i, 20.0 + i, 150.0 + 3 * i) for i in range(1, 5)]
    assert Gadget1(0).layout(*(lambda d: (len(d), lambda o, n: d[o : o + n]))((tmp_path / "g").read_bytes())).named(None) == ["Position", "GadgetVelocity", "ID", "Mass", "InternalEnergy"]
    with pytest.raises(Exception, match="no such columns"):
        files.read_gadget1(spark, str(tmp_path / "g"), 1, ("Density",)).count()


def test_stores_that_only_spark_opens(spark, stack, monkeypatch):
    def closed(path):
        raise pa.ArrowInvalid("Unrecognized filesystem type")

    monkeypatch.setattr(ranges, "_opened", closed)
    got = files.with_ids(read_ranges(spark, FlatBinary(FIELDS, 4), stack, ["ID"])).orderBy("id").collect()
    assert [(r["id"], r["own_ID"]) for r in got] == [(i, i) for i in range(133)]


def test_catalogs_of_files(spark, stack):
    c = files.FileCatalog(spark, FlatBinary(FIELDS, 4), stack, ["Mass", "ID"], {"BoxSize": 1.0})
    assert c.size == 133 and [r["own_ID"] for r in c[[-1, 0]].df.orderBy("id").collect()] == [132, 0]
    part = c.query_range(60, 90).query_range(5, 20)
    assert [(r["id"], r["own_ID"]) for r in part.df.orderBy("id").collect()] == [(i, 65 + i) for i in range(15)] and part.attrs == {"BoxSize": 1.0}
    assert c.query_range(120, 500).size == 13
    more = c.with_column("twice", F.col("Mass") * 2)
    assert more.df.agg(F.sum("twice")).first()[0] == 4 * sum(range(133))
    with pytest.raises(ValueError):
        more.query_range(0, 1)
    assert [r["own_ID"] for r in c[c["own_ID"] % 50 == 0][1:3].df.orderBy("id").collect()] == [50, 100]


def test_lines_of_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n" + "".join(f"{i} {i * 2} # x\n\n" if i % 3 else f"{i}\n" for i in range(40)))
    (tmp_path / "b.txt").write_text("".join(f"{i} 1\n" for i in range(100, 103)))
    df = files.read_csv(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], ["a", "b"], {"a": "int"}, skiprows=2, nrows=5)
    assert sorted(map(tuple, df.collect())) == [(2, 4.0), (3, None), (4, 8.0), (5, 10.0), (6, None), (102, 1.0)]
    assert files.read_csv(spark, str(tmp_path / "a.txt"), ["a", "b"]).where("b is null").count() == 14
