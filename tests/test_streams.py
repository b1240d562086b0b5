"""Streams in several batches against the same objects as a table; late objects are dropped."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import mesh as M
from skyloom.plans.scratch import Scratch
from skyloom.streaming import windows

SCHEMA = "ts timestamp, x double, y double, z double, w double"


def day(d, hour=0):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(days=d, hours=hour)


def batches(spark, folder, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/p{k}")
        # Batches are taken in the order in which their files were written.
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(spark, stream, keys):
    s = Scratch(spark)
    q = windows.keep_updates(stream, f"{s.root}/u", f"{s.root}/c")
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) > 1
    return windows.latest(spark, f"{s.root}/u", stream.schema, keys), f"{s.root}/u"


def objects(days, seed, n=30):
    rng = np.random.default_rng(seed)
    return [(day(int(rng.choice(days)), int(rng.integers(24))), *map(float, rng.random(3) * 10), float(rng.random())) for _ in range(n)]


@pytest.mark.parametrize("cells", [4, (4, 3, 5)])
def test_painted_windows_equal_painted_tables(spark, tmp_path, cells):
    parts = [objects([0, 1], 1), objects([1, 2], 2), objects([2, 3], 3)]
    stream = windows.painted(batches(spark, str(tmp_path), parts), cells, 10.0, delay="1 day", weight=F.col("w"), window="tsc")
    got, _ = run(spark, stream, ["start", *M.CELL])
    found = {(r["start"].day, r["ix"], r["iy"], r["iz"]): r["v"] for r in got.collect()}
    whole = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    want = {}
    for d in range(4):
        for r in M.paint(whole.where(F.dayofmonth("ts") == d + 1), cells, 10.0, "tsc", F.col("w")).collect():
            want[d + 1, r["ix"], r["iy"], r["iz"]] = r["v"]
    assert found.keys() == want.keys() and all(np.isclose(found[k], want[k]) for k in want)


def test_late_objects_are_dropped_and_closed_windows_stay(spark, tmp_path):
    at = lambda d, v: (day(d), v, 0.0, 0.0, 2.0)
    parts = [[at(0, 0.5), at(3, 1.5)], [at(0, 0.6), at(2, 0.7)], [at(4, 9.0), at(3, 1.0), at(3, -1.0), at(0, 0.7), at(1, 0.7), (None, 0.5, 0.0, 0.0, 1.0)]]
    stream = windows.histogram(batches(spark, str(tmp_path), parts), F.col("x"), [0.0, 1.0, 2.0], delay="1 day", weight=F.col("w"))
    got, folder = run(spark, stream, ["start", "bin"])
    # The first batch reached day 3: windows that ended by day 2 are closed with the second one, which may still add to them.
    assert {(r["start"].day - 1, r["bin"]): r["n"] for r in got.collect()} == {(0, 0): 4.0, (3, 1): 4.0, (2, 0): 2.0}
    early = windows.closed(spark, folder, stream.schema, ["start", "bin"], F.lit(day(2)))
    assert [r["n"] for r in early.collect()] == [4.0]


def test_sliding_windows(spark, tmp_path):
    parts = [[(day(0, h), 0.5, 0.0, 0.0, 1.0)] for h in (1, 7, 13)]
    stream = windows.histogram(batches(spark, str(tmp_path), parts), F.col("x"), [0.0, 1.0], every="12 hours", slide="6 hours", delay="2 days")
    got, _ = run(spark, stream, ["start", "bin"])
    assert sorted(r["n"] for r in got.collect()) == [1.0, 1.0, 2.0, 2.0]
