"""Scoring by joins: of the model only what single words need is broadcast."""

import numpy as np
from pyspark.sql import DataFrame
from tests.llm.texts import frame, rows

from skyloom.llm import quality


def test_bigrams_stay_in_tables(spark, monkeypatch):
    shared = []
    real = type(spark.sparkContext).broadcast
    monkeypatch.setattr(DataFrame, "toPandas", lambda *a: 1 / 0)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (shared.append(value), real(self, value))[1])
    labels = spark.createDataFrame([(i, 1) for i in range(1, 14)], "doc_id long, quality int")
    quality.classify_quality(frame(spark, [*rows(), (30, "a " * 70_000)]), labels).count()
    assert [type(x) for x in shared] == [quality.Model]
    assert all(len(x) <= quality.BUCKETS + 2 for x in vars(shared[0]).values())


def test_packed_numbers():
    for a in (np.zeros(0, np.int64), np.array([0, 5, 2**41, 7]), np.arange(300)):
        assert quality.unpack(quality.pack(a, "<u8"), "<u8").tolist() == a.tolist()
