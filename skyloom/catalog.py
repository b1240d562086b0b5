"""A catalog: a DataFrame of objects with an id, coordinates and free columns, and a dict of attributes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.values import dumps, loads
from skyloom.operators.box import Cells, Sides
from skyloom.operators.field import Mesh
from skyloom.operators.numbering import dense_index

DEFAULTS = {"Selection": lambda: F.lit(True), "Weight": lambda: F.lit(1.0), "Value": lambda: F.lit(1.0)}


def column(method: Callable[[Catalog], Column]) -> Callable[[Catalog], Column]:
    """Marks a method of a catalog class as a derived column: looked up by its name, made when it is asked for."""
    method.is_column = True
    return method


class Catalog:
    """Columns are looked up as own columns first, then as derived columns of the class, then as defaults (Selection, Weight, Value).

    Rows have an order: that of their ids, or of the last sort. Positions count in it. Ids that are known
    to be 0.. in this order are positions; where they are not, as after a filter or a sort, rows are
    numbered anew, by ranges, when positions are first asked for.
    """

    def __init__(self, df: DataFrame, attrs: Mapping | None = None, dense: bool = False, order: Sequence[Column] = ()):
        self.df, self.attrs, self.is_dense, self.order = df, dict(attrs or {}), dense, tuple(order)

    def _with(self, df: DataFrame, dense: bool | None = None) -> Catalog:
        return type(self)(df, self.attrs, self.is_dense if dense is None else dense, self.order)

    @classmethod
    def from_arrays(cls, spark: SparkSession, data: Mapping[str, Sequence], **attrs) -> Catalog:
        """Columns of equal length; the id is the position."""
        sizes = {len(v) for v in data.values()}
        if len(sizes) != 1:
            raise ValueError(f"columns of different lengths: {sorted(sizes)}")
        rows = [(i, *[x.tolist() if hasattr(x, "tolist") else x for x in r]) for i, r in enumerate(zip(*data.values(), strict=True))]
        return cls(spark.createDataFrame(rows, ["id", *data]), attrs, dense=True)

    @classmethod
    def derived(cls) -> list[str]:
        return [name for name in dir(cls) if getattr(getattr(cls, name), "is_column", False)]

    @property
    def columns(self) -> list[str]:
        return sorted({*self.df.columns, *self.derived(), *DEFAULTS})

    @property
    def size(self) -> int:
        return self.df.count()

    def __getitem__(self, key):
        """A name gives a Column, names a projection, a boolean Column a filter, a slice or whole numbers rows by position."""
        if isinstance(key, str):
            if key in self.df.columns:
                return self.df[key]
            if key in self.derived():
                return getattr(self, key)()
            if key in DEFAULTS:
                return DEFAULTS[key]()
            raise KeyError(key)
        if isinstance(key, Column):
            return self._with(self.df.where(key), False)
        if isinstance(key, slice):
            return self.gslice(key.start, key.stop, key.step)
        if isinstance(key, (list, tuple)) and all(isinstance(k, str) for k in key):
            kept = self.dense() if self.order else self
            return kept._with(kept.df.select("id", *[kept[k].alias(k) for k in key if k != "id"]))
        if isinstance(key, (list, tuple)) and all(isinstance(k, int) and not isinstance(k, bool) for k in key):
            return self._take(key)
        raise KeyError(key)

    def _take(self, places: Sequence[int]) -> Catalog:
        """Rows at positions, in their order and as often as named; the new id is the place in the list."""
        n, own = self.size, self.dense()
        if bad := [k for k in places if not -n <= k < n]:
            raise IndexError(bad[0])
        wanted = self.df.sparkSession.createDataFrame([(i, k % n) for i, k in enumerate(places)], "_place long, id long")
        # The list came from the driver, so it is small.
        found = own.df.join(F.broadcast(wanted), "id").withColumn("id", F.col("_place"))
        return Catalog(found.select(*self.df.columns), self.attrs, dense=True)

    def dense(self) -> Catalog:
        """The same rows in the same order, with ids 0.. without gaps."""
        if self.is_dense:
            return self
        numbered = dense_index(self.df, [*self.order, "id"], "_place")
        found = self._with(numbered.select(*[F.col("_place").alias("id") if c == "id" else c for c in self.df.columns]), True)
        found.order = ()
        return found

    def copy(self) -> Catalog:
        return self._with(self.df)

    def to_mesh(self, n: Cells, box: Sides | None = None, window: str = "cic", interlaced: bool = False, compensated: bool = False, weight: str = "Weight", value: str = "Value", selection: str = "Selection") -> Mesh:
        """A grid of the catalog's density; the box is the attribute BoxSize, if not given."""
        return Mesh.from_points(self.df, n, box or self.attrs["BoxSize"], window, self[weight], self[value], self[selection], interlaced, compensated)

    def with_column(self, name: str, value) -> Catalog:
        return self._with(self.df.withColumn(name, value if isinstance(value, Column) else F.lit(value)))

    def drop(self, name: str) -> Catalog:
        if name not in self.df.columns or name == "id":
            raise ValueError(f"cannot delete {name}")
        return self._with(self.df.drop(name))

    def gslice(self, start: int | None = None, stop: int | None = None, step: int | None = None, redistribute: bool = False) -> Catalog:
        """Rows by position, as a slice of a sequence; a negative step turns their order. Ids are those of the positions."""
        by, own = step or 1, self.dense()
        if by > 0 and (start or 0) >= 0 and (stop is None or stop >= 0):
            # The number of rows does not matter.
            lo, hi = start or 0, stop
        else:
            lo, hi, _ = slice(start, stop, by).indices(self.size)
            if by < 0:
                # The same rows, counted from below.
                n = max((lo - hi - by - 1) // -by, 0)
                lo, hi = lo + (n - 1) * by, lo + 1 if n else lo
        keep = F.col("id") >= lo
        if hi is not None:
            keep &= F.col("id") < hi
        if abs(by) > 1:
            keep &= (F.col("id") - lo) % abs(by) == 0
        df = own.df.where(keep)
        return Catalog(df.repartition("id") if redistribute else df, self.attrs, order=[F.col("id").desc()] if by < 0 else [])

    def sort(self, keys: str | Sequence[str], reverse: bool = False, columns: Sequence[str] | None = None) -> Catalog:
        """By numeric order of the keys, the first key first; ties by id."""
        keys = [keys] if isinstance(keys, str) else list(keys)
        if len(set(keys)) != len(keys):
            raise ValueError("duplicate sort keys")
        order = [F.col(k).desc() if reverse else F.col(k).asc() for k in keys]
        found = self._with(self.df.orderBy(*order, "id"), False)
        found.order = tuple(order)
        if columns is None:
            return found
        found = found.dense() if set(keys) - {"id", *columns} else found
        return found._with(found.df.select("id", *[found[c].alias(c) for c in columns]))

    def concat(self, *others: Catalog, columns: Sequence[str] | None = None) -> Catalog:
        """Rows of all catalogs by the columns of the first; ids are the positions in the whole."""
        names = list(columns or [c for c in self.df.columns if c != "id"])
        for o in others:
            if missing := [c for c in names if c not in o.columns]:
                raise ValueError(f"missing columns {missing}")
        out, shift = None, 0
        for c in (self, *others):
            o = c.dense()
            part = o.df.select((F.col("id") + shift).alias("id"), *[o[n].alias(n) for n in names])
            out = part if out is None else out.unionByName(part)
            shift += c.size if c is not (self, *others)[-1] else 0
        return Catalog(out, self.attrs, dense=True)

    def persist(self) -> Catalog:
        return self._with(self.df.cache())

    def save(self, path: str, columns: Sequence[str] | None = None, rows_per_file: int = 32 << 20) -> None:
        """A Parquet directory, with the attributes beside it as one JSON row."""
        names, own = list(columns or [c for c in self.df.columns if c != "id"]), self.dense() if self.order else self
        own.df.select("id", *[own[c].alias(c) for c in names]).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/columns")
        self.df.sparkSession.createDataFrame([(dumps({"attrs": self.attrs, "dense": own.is_dense}),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/attrs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        about = loads(spark.read.text(f"{path}/attrs").first()[0])
        return cls(spark.read.parquet(f"{path}/columns"), about["attrs"], about["dense"])


def species(**catalogs: Catalog) -> Catalog:
    """A named union of catalogs: a species column, columns missing in one are null, attributes prefixed by the name."""
    out, attrs = None, {}
    for name, c in catalogs.items():
        part = c.df.withColumn("species", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        attrs |= {f"{name}.{k}": v for k, v in c.attrs.items()}
    return Catalog(out, attrs)


def stack(*columns: Column) -> Column:
    """Scalar columns as one array column."""
    return F.array(*columns)


def positions(key: str, box: float) -> list[Column]:
    """Three coordinates in [0, box) from an integer key by exact integer arithmetic; the same in any SQL engine."""
    return [F.expr(position_sql(key, axis, box)).alias(axis) for axis in "xyz"]


def position_sql(key: str, axis: str, box: float) -> str:
    # Multiplier and shift of each axis.
    a, b = {"x": (1103515245, 48271), "y": (214748357, 69621), "z": (1664525123, 16807)}[axis]
    m = f"(({key}) * {a} % 2147483647)"
    return f"(cast(({m} * ({m} + {b})) % 1000000007 as double) / 1000000007 * {box:g})"
