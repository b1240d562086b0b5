"""Shared helpers of the document operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.plans.scratch import Scratch

__all__ = ["KEY", "NULL_ID", "Scratch", "free_shuffles", "packed_texts", "row_key", "text_or_empty"]

#: Stands for a null doc_id inside operators that key rows by it.
NULL_ID = -(2**63)
#: Name of a column of row keys beside the documents' own columns.
KEY = "skyloom row key"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key() -> Column:
    """doc_id; a row without one is named by its text, with a number above 2^62."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**62) + F.xxhash64(text_or_empty()).bitwiseAND(2**61 - 1))


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps, which it does once their plans are collected.

    Twice, as what the first collection lets go may hold shuffles that only the second one finds.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def packed_texts(docs: DataFrame) -> DataFrame:
    """(id, z): texts compressed for a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "z": [z.compress((t or "").encode("utf-8", "replace")) for t in pdf["text"]]})

    return docs.select("id", "text").mapInPandas(run, "id long, z binary")
