"""Painted grids and histograms of a stream of objects, by windows of event time.

Painting and binning are sums, so they run on a stream as they run on a table: every object becomes its
cells (or its bin), and these are added up in state, keyed by window and cell. A watermark bounds the
state: a window is closed with the batch after the one whose latest time is `delay` past its end, and
objects of it that come later are dropped, as are those without a time. Results are kept as a table of updates, one folder for each batch of the stream; a batch that is
run again after a failure writes its folder anew, so each window's last update is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.sky import bin_of
from skyloom.operators import mesh as M
from skyloom.operators.box import Cells, Sides


def _windowed(stream: DataFrame, time: str, every: str, delay: str, slide: str | None) -> tuple[DataFrame, Column]:
    if dict(stream.dtypes)[time] == "timestamp_ntz":
        # Times without a zone are taken as UTC, whatever the session's zone.
        micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{time}`)")
        stream = stream.withColumn(time, F.timestamp_micros(micros))
    return stream.withWatermark(time, delay), F.window(time, every, slide or every)


def painted(stream: DataFrame, n: Cells, box: Sides, time: str = "ts", every: str = "1 day", delay: str = "1 day", slide: str | None = None, window: str = "cic", weight: Column | float = 1.0) -> DataFrame:
    """start, ix, iy, iz, v: the mass painted from objects x, y, z of each window of time, tumbling or sliding."""
    marked, span = _windowed(stream, time, every, delay, slide)
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    at = M.spread(marked.withColumn("_m", w.cast("double")), n, box, window, [F.col(time), F.col("_m")])
    found = at.groupBy(span.alias("span"), *M.CELL).agg(F.sum(F.col("w") * F.col("_m")).alias("v"))
    return found.select(F.col("span.start").alias("start"), *M.CELL, "v")


def histogram(stream: DataFrame, value: Column, edges: Sequence[float], time: str = "ts", every: str = "1 day", delay: str = "1 day", slide: str | None = None, weight: Column | float = 1.0) -> DataFrame:
    """start, bin, n: weighted numbers of values in bins [edge, next edge) for each window of time; values outside have no bin."""
    marked, span = _windowed(stream, time, every, delay, slide)
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    binned = marked.withColumn("bin", bin_of(value, list(edges))).where((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1))
    found = binned.groupBy(span.alias("span"), "bin").agg(F.sum(w).cast("double").alias("n"))
    return found.select(F.col("span.start").alias("start"), "bin", "n")


def keep_updates(stream: DataFrame, folder: str, checkpoint: str, **trigger):
    """Starts the stream; each batch's updates go to a folder of its own. By default it ends when all there is has been read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def latest(spark: SparkSession, folder: str, schema, keys: Sequence[str]) -> DataFrame:
    """The last update of each key in a folder of updates."""
    kept = spark.read.schema(schema.add("batch", "long")).parquet(folder)
    values = [c for c in kept.columns if c not in (*keys, "batch")]
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*")


def closed(spark: SparkSession, folder: str, schema, keys: Sequence[str], upto: Column) -> DataFrame:
    """The last updates of windows that start before a time, as when their end and the delay are past."""
    return latest(spark, folder, schema, keys).where(F.col("start") < upto)
