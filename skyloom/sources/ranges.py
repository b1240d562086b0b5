"""Binary files read by ranges of rows: a data source with one partition for each range.

A format tells where the columns of a file lie (a Layout); everything else is common to all formats. The
driver reads sizes and headers alone. A task gets a range of rows of one file and reads, of each column
that is asked for, the bytes of these rows; where columns are stored row by row it reads the rows. Files
of a stack are in the order of their names, and `id` numbers their rows through, so ids are dense
without a job (row_id, where the file has a column of that name in any case). start, stop and step slice the rows of the whole stack, before anything is read.

Files are opened through Arrow's file systems. Where it has none for a path, Spark's own binary reader
gives whole files, which one task each decodes by the same layouts.

User formats are registered with register_format(); then spark.read.format(name).load(path) reads them,
with options columns (a comma list), start, stop, step and rows_per_task.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: (offset, length) -> bytes
Reader = Callable[[int, int], bytes]
#: name, numpy type of one element, elements to a row
Field = tuple[str, str, int]

_SQL = {"f4": "float", "f8": "double", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "u8": "bigint"}
_ARROW = {"float": pa.float32(), "double": pa.float64(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
#: Rows to a task and to a batch.
ROWS_PER_TASK, BATCH = 1 << 20, 1 << 16


@dataclass(frozen=True)
class Block:
    """Where a column lies: row r begins at offset + r * stride. A constant lies nowhere.

    Values are zero + scale * stored; `out` is the numpy type that they come as.
    """

    kind: str
    width: int = 1
    offset: int = 0
    stride: int = 0
    scale: float = 1.0
    zero: float = 0.0
    constant: float | None = None
    out: str | None = None

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.kind).itemsize * self.width

    @property
    def sql(self) -> str:
        kind = self.out or self.kind
        if self.out is None and (self.scale, self.zero) != (1.0, 0.0):
            kind = "i8" if np.dtype(self.kind).kind in "iu" and self.scale == 1.0 and float(self.zero).is_integer() else "f8"
        return _SQL[np.dtype(kind).str[1:]]

    def read(self, read: Reader, start: int, stop: int) -> np.ndarray:
        n, kind = stop - start, np.dtype(self.kind)
        if self.constant is not None:
            return np.full(n, self.constant)
        stride = self.stride or self.row_bytes
        raw = read(self.offset + start * stride, (n - 1) * stride + self.row_bytes if n else 0)
        a = np.ndarray((n, self.width), kind, raw, strides=(stride, kind.itemsize)) if n else np.empty((0, self.width), kind)
        if (self.scale, self.zero) == (1.0, 0.0):
            return a
        if kind.kind in "iu" and self.scale == 1.0 and float(self.zero).is_integer():
            # Offsets as of unsigned numbers stay whole; 2^63 leaves the range of a long and wraps.
            return a.astype("i8") + np.int64(int(self.zero)) if abs(self.zero) < 2.0**63 else a.astype("u8") + np.uint64(2**63)
        return a * self.scale + self.zero


@dataclass(frozen=True)
class Layout:
    rows: int
    blocks: Mapping[str, Block]

    def sql(self, columns: Sequence[str]) -> str:
        return ", ".join(f"`{c}` " + (self.blocks[c].sql if self.blocks[c].width == 1 else f"array<{self.blocks[c].sql}>") for c in columns)

    def named(self, columns: Sequence[str] | None) -> list[str]:
        if missing := [c for c in columns or [] if c not in self.blocks]:
            raise ValueError(f"no such columns: {missing}")
        return list(columns or self.blocks)


class Format(ABC):
    """A file format; what it needs must be picklable, as tasks get it as it is."""

    @abstractmethod
    def layout(self, size: int, read: Reader) -> Layout:
        """The rows and columns of a file of so many bytes."""


@dataclass(frozen=True)
class FlatBinary(Format):
    """One column after another behind a header; rows follow from the size, if not given, and must fit it.

    offsets names the first byte of columns that do not follow the one before.
    """

    fields: Sequence[Field]
    header: int = 0
    rows: int | None = None
    offsets: Mapping[str, int] | None = None

    def layout(self, size: int, read: Reader) -> Layout:
        row = sum(np.dtype(kind).itemsize * width for _, kind, width in self.fields)
        n, rest = (self.rows, 0) if self.rows is not None else divmod(size - self.header, row)
        blocks, at = {}, self.header
        for name, kind, width in self.fields:
            at = (self.offsets or {}).get(name, at)
            blocks[name] = Block(kind, width, at)
            at += n * blocks[name].row_bytes
        if rest or n < 0 or any(b.offset + n * b.row_bytes > size for b in blocks.values()):
            raise ValueError(f"{size - self.header} bytes are not a whole number of rows of {row} bytes")
        return Layout(n, blocks)


#: The blocks of a snapshot of format 1 in order, with their kind (float, unsigned), width and
#: whether only gas (type 0) has them; Mass is there for types without a mass in the header.
GADGET_BLOCKS = (("Position", "f", 3, False), ("GadgetVelocity", "f", 3, False), ("ID", "u", 1, False), ("Mass", "f", 1, False), ("InternalEnergy", "f", 1, True), ("Density", "f", 1, True), ("SmoothingLength", "f", 1, True))
#: What is read of the header: particles and masses of the six types.
GADGET_HEADER = (("Npart", "<u4", 6), ("Massarr", "<f8", 6))


@dataclass(frozen=True)
class Gadget1(Format):
    """Particles of one type of a format-1 snapshot: length-framed records; an element's size follows from a record's length."""

    ptype: int = 1
    blocks: Sequence[tuple[str, str, int, bool]] = GADGET_BLOCKS
    header: Sequence[Field] = GADGET_HEADER

    def layout(self, size: int, read: Reader) -> Layout:
        records, at = [], 0
        while at < size:
            n = int(np.frombuffer(read(at, 4), "<i4")[0])
            if n < 0 or at + n + 8 > size or int(np.frombuffer(read(at + 4 + n, 4), "<i4")[0]) != n:
                raise ValueError("a record's two lengths differ")
            records.append((at + 4, n))
            at += n + 8
        head = np.frombuffer(read(*records.pop(0)), np.dtype([(n, k, (w,)) for n, k, w in self.header]), 1)[0]
        count, masses = head["Npart"].astype(int), head["Massarr"]
        rows, out = int(count[self.ptype]), {}
        for name, kind, width, gas in self.blocks:
            here = [i for i in range(1 if gas else 6) if count[i] and (name != "Mass" or masses[i] == 0)]
            own = "f8" if kind == "f" else "i8"
            if name == "Mass" and rows and self.ptype not in here:
                out[name] = Block("f8", constant=float(masses[self.ptype]), out="f8")
            if not here or not records:
                continue
            first, length = records.pop(0)
            element = length // (sum(count[i] for i in here) * width)
            if self.ptype in here:
                before = int(sum(count[i] for i in here if i < self.ptype))
                out[name] = Block(f"<{kind}{element}", width, first + before * width * element, out=own)
        return Layout(rows, out)


#: Letters of FITS column formats.
FITS_TYPES = {"E": ">f4", "D": ">f8", "I": ">i2", "J": ">i4", "K": ">i8", "B": "u1"}


@dataclass(frozen=True)
class FitsTable(Format):
    """The first binary table of a FITS file, or unit ext, where an image is an error; columns are found in its header.

    Scaled columns come as zero + scale * stored; whole numbers stay whole where the scale is 1. Columns of other than numbers are left out.
    """

    ext: int | None = None

    def layout(self, size: int, read: Reader) -> Layout:
        at, unit = 0, 0
        while at < size:
            cards: dict[str, str] = {}
            while "END" not in cards and at < size:
                data = read(at, 2880)
                for c in range(0, len(data), 80):
                    card = data[c : c + 80].decode("ascii", "replace")
                    cards.setdefault(card[:8].strip(), card[10:].split(" /")[0].strip().strip("'").strip())
                at += 2880
            table = cards.get("XTENSION") == "BINTABLE"
            if self.ext == unit and not table:
                raise ValueError(f"unit {unit} is not a binary table")
            if table and self.ext in (None, unit):
                return Layout(int(cards["NAXIS2"]), self._columns(cards, at))
            axes = [int(cards[f"NAXIS{i + 1}"]) for i in range(int(cards.get("NAXIS", 0)))]
            held = abs(int(cards.get("BITPIX", 8))) // 8 * int(cards.get("GCOUNT", 1)) * int(np.prod(axes)) + int(cards.get("PCOUNT", 0)) if axes else 0
            at += -(-held // 2880) * 2880
            unit += 1
        raise ValueError("no binary table")

    def _columns(self, cards: dict[str, str], at: int) -> dict[str, Block]:
        # Bytes of the letters that are no numbers here: text, logical, bits (eight to a byte), descriptors, complex.
        other, stride, out = {"A": 1, "L": 1, "P": 8, "Q": 16, "C": 8, "M": 16}, int(cards["NAXIS1"]), {}
        number = lambda key, default: float(cards.get(key, default).upper().replace("D", "E"))
        for k in range(1, int(cards["TFIELDS"]) + 1):
            times, letter = re.fullmatch(r"(\d*)([A-Z]).*", cards[f"TFORM{k}"]).groups()
            width = int(times or 1)
            if letter in FITS_TYPES:
                if width:
                    out[cards[f"TTYPE{k}"]] = Block(FITS_TYPES[letter], width, at, stride, number(f"TSCAL{k}", "1"), number(f"TZERO{k}", "0"))
                at += np.dtype(FITS_TYPES[letter]).itemsize * width
            else:
                at += -(-width // 8) if letter == "X" else other[letter] * width
        return out


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else posixpath.abspath(path))


def list_files(paths: str | Sequence[str]) -> list[tuple[str, int]]:
    """(file, bytes) of paths, folders and patterns in the last part of a path, in the order of names for each."""
    out: list[tuple[str, int]] = []
    for path in [paths] if isinstance(paths, str) else paths:
        store, at = _opened(path)
        scheme = path[: path.index("://") + 3] + path[path.index("://") + 3 :].split("/")[0] if "://" in path else ""
        parent, pattern = posixpath.split(at)
        info = store.get_file_info(at) if not re.search(r"[*?\[]", pattern) else None
        if info is None or info.type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(at if info else parent))
            found = [f for f in found if f.is_file and fnmatch.fnmatchcase(f.base_name, "*" if info else pattern) and not f.base_name.startswith(("_", "."))]
        else:
            found = [info] if info.is_file else []
        if not found:
            raise FileNotFoundError(path)
        out += sorted((f"{scheme}{f.path}", f.size) for f in found)
    return out


def _reader(path: str) -> Reader:
    store, at = _opened(path)

    def read(offset: int, length: int) -> bytes:
        with store.open_input_file(at) as f:
            return f.read_at(length, offset) if length else b""

    return read


@dataclass
class RowRange(InputPartition):
    """Rows start:stop:step of a file with its layout; the first one has this id."""

    file: str
    layout: Layout
    start: int
    stop: int
    step: int
    id: int

    def batches(self, columns: Sequence[str], read: Reader, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        size = max(BATCH // self.step, 1) * self.step
        for a in range(self.start, self.stop, size):
            b = min(a + size, self.stop)
            rows = np.arange(a, b, self.step)
            out = [pa.array(self.id + (rows - self.start) // self.step), pa.array([self.file] * len(rows), pa.string()), pa.array(rows)]
            for c in columns:
                block = self.layout.blocks[c]
                values = block.read(read, a, b)[:: self.step].astype(np.dtype(_ARROW[block.sql].to_pandas_dtype()))
                flat = pa.array(np.ascontiguousarray(values).ravel())
                out.append(flat if block.width == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * block.width), flat))
            yield pa.RecordBatch.from_arrays(out, schema=schema)


def id_name(columns: Sequence[str]) -> str:
    """The name of the numbers of rows: id, or row_id beside a column of the file that Spark would not tell from it."""
    return "row_id" if any(c.lower() == "id" for c in columns) else "id"


def arrow_schema(layout: Layout, columns: Sequence[str]) -> pa.Schema:
    own = [(c, _ARROW[layout.blocks[c].sql] if layout.blocks[c].width == 1 else pa.list_(_ARROW[layout.blocks[c].sql])) for c in columns]
    return pa.schema([(id_name(columns), pa.int64()), ("file", pa.string()), ("row", pa.int64()), *own])


def plan_ranges(files: Sequence[tuple[str, Layout]], start: int | None = None, stop: int | None = None, step: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> list[RowRange]:
    """Row ranges of a stack of files for a slice of all its rows, as of a sequence; steps must be positive."""
    if (step or 1) < 1:
        raise ValueError("a step must be positive")
    first, last, by = slice(start, stop, step).indices(sum(layout.rows for _, layout in files))
    out, before = [], 0
    size = max(rows_per_task // by, 1) * by
    for file, layout in files:
        # The first row of this file that the slice meets.
        lo = max(first - before, 0)
        lo += (first - before - lo) % by
        hi = min(last - before, layout.rows)
        out += [RowRange(file, layout, a, min(a + size, hi), by, (before + a - first) // by) for a in range(lo, hi, size)]
        before += layout.rows
    return out


class RangeReader(DataSourceReader):
    def __init__(self, form: Format, options: Mapping[str, str]):
        self.form, self.options = form, dict(options)
        path = self.options["path"]
        self.files = list_files(json.loads(path) if path.startswith("[") else path)
        self.layouts: list[Layout] | None = None

    def _layouts(self) -> list[Layout]:
        if self.layouts is None:
            with ThreadPoolExecutor(16) as pool:
                self.layouts = list(pool.map(lambda f: self.form.layout(f[1], _reader(f[0])), self.files))
        return self.layouts

    def first(self) -> Layout:
        """The first file's layout tells the columns."""
        return self.form.layout(self.files[0][1], _reader(self.files[0][0]))

    def columns(self) -> list[str]:
        names = self.options.get("columns")
        return self.first().named([c.strip() for c in names.split(",") if c.strip()] if names else None)

    def partitions(self) -> Sequence[InputPartition]:
        number = lambda name: int(self.options[name]) if self.options.get(name) else None
        ranges = plan_ranges([(f, x) for (f, _), x in zip(self.files, self._layouts(), strict=True)], number("start"), number("stop"), number("step"), number("rows_per_task") or ROWS_PER_TASK)
        return ranges or [RowRange("", self.first(), 0, 0, 1, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        columns = self.columns() if partition.stop > partition.start else []
        yield from partition.batches(columns, _reader(partition.file), arrow_schema(partition.layout, columns)) if columns or partition.stop > partition.start else ()


def register_format(spark: SparkSession, name: str, form: Format) -> None:
    """Makes spark.read.format(name) read files of a format."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            r = RangeReader(form, self.options)
            return f"{id_name(r.columns())} bigint, file string, row bigint, {r.first().sql(r.columns())}"

        def reader(self, schema: StructType) -> RangeReader:
            return RangeReader(form, self.options)

    spark.dataSource.register(Source)


def _whole_files(spark: SparkSession, form: Format, paths: str | Sequence[str], columns: Sequence[str] | None) -> DataFrame:
    """Files that only Spark can open: each is decoded whole in the task that reads it; file and row, no ids."""
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select("path", "content")
    head = files.orderBy("path").first()
    at = lambda data: lambda offset, length: data[offset : offset + length]
    layout = form.layout(len(head["content"]), at(head["content"]))
    names = layout.named(columns)
    schema = arrow_schema(layout, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = form.layout(len(r["content"]), at(r["content"]))
                for b in RowRange(r["path"], own, 0, own.rows, 1, 0).batches(names, at(r["content"]), schema):
                    yield b.drop_columns([id_name(names)])

    return files.mapInArrow(run, f"file string, row bigint, {layout.sql(names)}")


def _write_file(path: str, fields: Sequence[Field], header: bytes, table: pa.Table) -> None:
    """One file: the header, then column after column; it gets its name when it is whole, so a task may be repeated."""
    files, at = _opened(path)
    with files.open_output_stream(part := f"{at}.{uuid.uuid4().hex}.tmp") as out:
        out.write(header)
        for name, kind, width in fields:
            column = table[name].combine_chunks()
            if column.null_count or (width > 1 and column.flatten().null_count):
                raise ValueError(f"{name} has nulls, which flat binary cannot hold")
            values = (column.flatten() if width > 1 else column).to_numpy(zero_copy_only=False)
            if len(values) != table.num_rows * width:
                raise ValueError(f"{name} has rows of other lengths than {width}")
            out.write(values.astype(np.dtype(kind), copy=False).tobytes())
    files.move(part, at)


def write_ranges(df: DataFrame, path: str, fields: Sequence[Field], header: bytes = b"", rows_per_file: int = ROWS_PER_TASK) -> int:
    """Writes the rows of each partition, in their order, as flat binary files of at most rows_per_file rows; returns their number.

    Names of files follow the partitions' numbers, so a table that is sorted by ranges is read again in its order.
    """
    files, at = _opened(path)
    files.create_dir(at, recursive=True)
    if files.get_file_info(fs.FileSelector(at)):
        raise FileExistsError(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, number, total = [], 0, 0, 0
        own = TaskContext.get().partitionId()

        def flush() -> None:
            nonlocal held, rows, number
            table = pa.Table.from_batches(held)
            _write_file(f"{path}/part-{own:06d}-{number:06d}", fields, header, table)
            held, rows, number = [], 0, number + 1

        for batch in batches:
            total += batch.num_rows
            while batch.num_rows:
                first, batch = batch.slice(0, rows_per_file - rows), batch.slice(rows_per_file - rows)
                held.append(first)
                rows += first.num_rows
                if rows == rows_per_file:
                    flush()
        if rows:
            flush()
        yield pa.RecordBatch.from_pydict({"rows": [total]})

    return df.select(*[f[0] for f in fields]).mapInArrow(run, "rows long").groupBy().sum("rows").first()[0] or 0


def read_ranges(spark: SparkSession, form: Format, paths: str | Sequence[str], columns: Sequence[str] | None = None, start: int | None = None, stop: int | None = None, step: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """id (or row_id), file, row and the columns of a stack of files, or of a slice of its rows, in one task for each range of rows."""
    try:
        _opened(paths if isinstance(paths, str) else paths[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        if (start, stop, step) != (None, None, None):
            raise
        return _whole_files(spark, form, paths, columns)
    register_format(spark, name := f"skyloom_{type(form).__name__.lower()}_{abs(hash(repr(form))):x}", form)
    r = spark.read.format(name).option("rows_per_task", rows_per_task)
    for key, value in (("start", start), ("stop", stop), ("step", step), ("columns", ",".join(columns) if columns else None)):
        if value is not None:
            r = r.option(key, value)
    return r.load(paths if isinstance(paths, str) else json.dumps(list(paths)))
