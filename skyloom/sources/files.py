"""Readers of catalog files: delimited text, flat column-major binaries, particle snapshots and FITS tables.

Text goes through Spark's own readers. Binary formats are read by ranges of rows (see ranges.py): a row has
its dense `id` over all files in the order of names, `file` and `row`.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.catalog import Catalog
from skyloom.plans.scratch import Scratch
from skyloom.sources.ranges import Field, FitsTable, FlatBinary, Format, Gadget1, read_ranges, write_ranges


def read_csv(spark: SparkSession, path: str | list[str], names: list[str], types: dict[str, str] | str = "double", usecols: list[str] | None = None, whitespace: bool = True, sep: str = ",", comment: str = "#", skiprows: int = 0, nrows: int | None = None) -> DataFrame:
    """Text without a header, one row to a line, blank and comment lines left out; fields parted by white space or sep.

    Missing fields at a line's end are null. skiprows and nrows count the lines with rows of each file, in its
    order: rows are numbered by ranges of the file, which costs a second pass; without them there is none.
    """
    if unknown := set(usecols or []) - set(names):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    line = F.trim(F.regexp_replace("value", r"\s+", " ")) if whitespace else F.trim("value")
    lines = spark.read.text(path).select(line.alias("line"), *([F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")] if skiprows or nrows is not None else []))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith(comment))
    if skiprows or nrows is not None:
        # Lines of one block of a file are read by one task, in their order.
        lines = Scratch(spark).keep(lines, "lines")
        counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
        starts = counts.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
        own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
        place = F.col("first") + F.col("own")
        lines = lines.withColumn("own", own).join(starts, ["file", "block"]).where((place >= skiprows) & (F.lit(True) if nrows is None else place < skiprows + nrows))
    parts = F.split("line", " " if whitespace else re.escape(sep))
    kind = lambda c: types if isinstance(types, str) else types.get(c, "double")
    return lines.select(parts.alias("p")).select(*[F.trim(F.get("p", F.lit(i))).cast(kind(c)).alias(c) for i, c in enumerate(names) if usecols is None or c in usecols])


def read_binary(spark: SparkSession, path: str | list[str], fields: list[Field], header: int = 0, size: int | None = None, offsets: dict[str, int] | None = None, **ranges) -> DataFrame:
    """Flat binary, one column after another behind a header; the number of rows follows from the file's size, which must fit."""
    return read_ranges(spark, FlatBinary(tuple(fields), header, size, offsets), path, **ranges)


def write_binary(df: DataFrame, path: str, fields: list[Field], header: bytes = b"", **files) -> int:
    """A folder of flat binary files that read_binary reads; columns of several elements are arrays. Returns the number of rows."""
    return write_ranges(df, path, fields, header, **files)


def read_tpm(spark: SparkSession, path: str | list[str], precision: str = "f4", **ranges) -> DataFrame:
    """Position, Velocity and ID behind a header of 28 bytes."""
    return read_binary(spark, path, [("Position", f"<{precision}", 3), ("Velocity", f"<{precision}", 3), ("ID", "<u8", 1)], header=28, **ranges)


def read_gadget1(spark: SparkSession, path: str | list[str], ptype: int = 1, columns: Sequence[str] = ("Position", "GadgetVelocity", "ID"), **ranges) -> DataFrame:
    """Particles of one type of a format-1 snapshot, masses from the header where it has them."""
    return read_ranges(spark, Gadget1(ptype), path, list(columns), **ranges)


def read_fits(spark: SparkSession, path: str | list[str], fields: list[Field] | None = None, ext: int | None = None, **ranges) -> DataFrame:
    """Columns of the first binary table of a FITS file, or of unit ext; an image there is an error. Without fields, all of its columns."""
    return read_ranges(spark, FitsTable(ext), path, [name for name, *_ in fields] if fields else None, **ranges)


class FileCatalog(Catalog):
    """A catalog of files of one format, of which ranges of rows can be named before anything is read."""

    def __init__(self, spark: SparkSession, form: Format, path: str | list[str], columns: Sequence[str] | None = None, attrs: dict | None = None, rows: tuple[int, int | None] = (0, None)):
        self.source, self.rows = (spark, form, path, columns), rows
        super().__init__(with_ids(read_ranges(spark, form, path, columns, rows[0], rows[1])), attrs, dense=True)
        self.names = self.df.columns

    def query_range(self, start: int, end: int) -> FileCatalog:
        """The rows start..end of this catalog's own rows, read alone; columns that were attached would be lost and are an error."""
        if self.df.columns != self.names:
            raise ValueError("columns were attached, so there is no range of files to read")
        if not 0 <= start <= end:
            raise ValueError("a range needs 0 <= start <= end")
        first, last = self.rows
        stop = first + end if last is None else min(first + end, last)
        return FileCatalog(*self.source, attrs=self.attrs, rows=(first + start, stop))

    def with_column(self, name: str, value) -> FileCatalog:
        return self._with(super().with_column(name, value).df)

    def _with(self, df: DataFrame, dense: bool | None = None) -> Catalog:
        """Filtered rows are no range of a file any more; other changes leave the catalog one of files."""
        if dense is not None:
            return Catalog(df, self.attrs, dense, self.order)
        out = self.copy()
        out.df = df
        return out

    def copy(self) -> FileCatalog:
        out = object.__new__(FileCatalog)
        out.__dict__ = {**self.__dict__, "attrs": dict(self.attrs)}
        return out


def with_ids(df: DataFrame) -> DataFrame:
    """Dense ids over file and row, in the order of names, where the reader gave none: one count for each file.

    A column of the file that Spark would not tell from id gets own_ before its name.
    """
    names = {c: f"own_{c}" if c.lower() == "id" and "row_id" in df.columns else c for c in df.columns if c not in ("file", "row", "row_id")}
    if "row_id" in df.columns:
        return df.select(F.col("row_id").alias("id"), *[F.col(c).alias(n) for c, n in names.items()])
    if "id" in df.columns:
        return df.drop("file", "row")
    counts = df.groupBy("file").agg(F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    names = {c: f"own_{c}" if c.lower() == "id" else c for c in names}
    return df.join(starts, "file").select((F.col("first") + F.col("row")).alias("id"), *[F.col(c).alias(n) for c, n in names.items()])


def as_array(df: DataFrame, columns: list[str]) -> Column:
    """Scalar columns of one type as one array column; mixed types are an error."""
    kinds = {dict(df.dtypes)[c] for c in columns}
    if len(kinds) > 1:
        raise ValueError(f"columns of different types: {sorted(kinds)}")
    return F.array(*columns)
