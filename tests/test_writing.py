"""Flat binary files written and read again, and halo mass definitions."""

import pytest
from pyspark.sql import functions as F

from skyloom.functions import sky
from skyloom.sources.files import read_binary, write_binary

FIELDS = [("K", ">i4", 1), ("P", "<f8", 2)]


@pytest.mark.parametrize("rows_per_file", [1, 7, 1000])
def test_rows_come_back_in_order(spark, tmp_path, rows_per_file):
    df = spark.range(100).select(F.col("id").cast("int").alias("K"), F.array(F.col("id") / 3, -F.col("id")).alias("P"))
    path = str(tmp_path / "rows")
    assert write_binary(df.repartitionByRange(3, "K").sortWithinPartitions("K"), path, FIELDS, b"head", rows_per_file=rows_per_file) == 100
    found = read_binary(spark, path, FIELDS, header=4).orderBy("id").collect()
    assert [(r["id"], r["K"], r["P"]) for r in found] == [(i, i, [i / 3, -float(i)]) for i in range(100)]
    assert not list((tmp_path / "rows").glob("*.tmp"))
    with pytest.raises(FileExistsError):
        write_binary(df, path, FIELDS)


def test_empty_table(spark, tmp_path):
    assert write_binary(spark.range(0).select(F.col("id").alias("K")), str(tmp_path / "none"), [("K", "<i8", 1)]) == 0


def test_what_cannot_be_written(spark, tmp_path):
    nulls = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "K int, P array<double>")
    short = spark.createDataFrame([(1, [1.0])], "K int, P array<double>")
    for k, df in enumerate((nulls, short)):
        with pytest.raises(Exception, match="nulls|other lengths"):
            write_binary(df, str(tmp_path / f"bad{k}"), FIELDS)


def test_mass_definitions():
    assert sky.halo_overdensity("200c", 0.3, 1.0, 0.0) == 200
    assert sky.halo_overdensity("200m", 0.3, 1.0, 0.0) == pytest.approx(60)
    assert sky.halo_overdensity("vir", 1.0, 1.0, 0.0) == pytest.approx(177.65, abs=0.01)
    for bad in ("virial", "c", "0m", "200x"):
        with pytest.raises(ValueError, match="mass definition"):
            sky.halo_overdensity(bad, 0.3, 1.0, 0.0)
