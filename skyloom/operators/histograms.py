"""Redshift histograms, bin widths, bounds, and operations on tables of bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.cosmology import Cosmology
from skyloom.functions.sky import bin_of
from skyloom.functions.values import dumps, loads


def bounds(df: DataFrame, pad: float = 0.02, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """axis, lo, hi, centre, box for each column: box = ceil(range * (1 + pad)), centre the middle."""
    agg = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, c in enumerate(columns)]))
    r = agg.select(rows.alias("r")).select("r.*")
    return r.withColumns({"centre": (F.col("lo") + F.col("hi")) / 2, "box": F.ceil((F.col("hi") - F.col("lo")) * (1 + pad)).cast("double")})


def scott(df: DataFrame, column: str) -> DataFrame:
    """Scott's bin width with the population deviation, and the number of bins."""
    s = df.agg(F.stddev_pop(column).alias("sd"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"))
    width = F.col("sd") * F.pow(24 * math.sqrt(math.pi) / F.col("n"), F.lit(1 / 3))
    return s.select(width.alias("width"), F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / width)).cast("long").alias("bins"), "lo", "hi")


def redshift_histogram(df: DataFrame, column: str, edges: list[float], fsky: float, cosmo: Cosmology, weight: str | None = None) -> DataFrame:
    """bin, lo, hi, n (summed weight), dv, nz = n / dv; bins [lo, hi), so the last edge is outside."""
    chi = cosmo.comoving_distance(edges)
    spark = df.sparkSession
    shells = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1]), float(4 / 3 * math.pi * fsky * (chi[i + 1] ** 3 - chi[i] ** 3))) for i in range(len(edges) - 1)], "bin int, lo double, hi double, dv double")
    n = df.withColumn("bin", bin_of(F.col(column), edges)).groupBy("bin").agg(F.sum(F.col(weight) if weight else F.lit(1.0)).alias("n"))
    out = shells.join(F.broadcast(n), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    return out.withColumn("nz", F.col("n") / F.col("dv"))


class Bins:
    """A small table of bins: one row for each, with an index column for each dimension and its edges."""

    def __init__(self, df: DataFrame, dims: dict[str, list[float]], attrs: dict | None = None):
        self.df, self.dims, self.attrs = df, {k: list(v) for k, v in dims.items()}, dict(attrs or {})

    def centres(self, dim: str) -> list[float]:
        e = self.dims[dim]
        return [(a + b) / 2 for a, b in zip(e[:-1], e[1:], strict=True)]

    def sel(self, method: str | None = None, **where: float) -> Bins:
        """Rows at coordinates, exact or nearest; a selected dimension goes, unless it is the last one."""
        out, dims = self.df, dict(self.dims)
        for dim, v in where.items():
            c = self.centres(dim)
            if method == "nearest":
                i = min(range(len(c)), key=lambda j: abs(c[j] - v))
            elif v in c:
                i = c.index(v)
            else:
                raise KeyError(v)
            if len(dims) == 1:
                raise ValueError("the last dimension cannot be squeezed")
            out, _ = out.where(F.col(dim) == i).drop(dim), dims.pop(dim)
        return Bins(out, dims, self.attrs)

    @property
    def variables(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.dims]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(e) - 1 for e in self.dims.values())

    def __getitem__(self, key) -> DataFrame | Bins:
        """A name gives that variable beside the dimensions, a list of names only those variables, numbers and slices the bins of each dimension in turn.

        A number keeps its dimension with one bin; squeeze() removes it.
        """
        if isinstance(key, str):
            if key not in self.variables:
                raise KeyError(key)
            return self.df.select(*self.dims, key)
        if isinstance(key, list) and all(isinstance(k, str) for k in key):
            if unknown := [k for k in key if k not in self.variables]:
                raise KeyError(unknown)
            return Bins(self.df.select(*self.dims, *key), self.dims, self.attrs)
        out, keys = self, key if isinstance(key, tuple) else (key,)
        if len(keys) > len(self.dims):
            raise IndexError("more places than dimensions")
        for dim, k in zip(self.dims, keys, strict=False):
            n = len(self.dims[dim]) - 1
            if isinstance(k, int):
                if not -n <= k < n:
                    raise IndexError(k)
                k = slice(k % n, k % n + 1)
            at = list(k) if isinstance(k, list) else list(range(n))[k]
            if not at or any(not -n <= i < n for i in at):
                raise IndexError(f"no such bins of {dim}: {k}")
            out = out.pick(dim, [i % n for i in at])
        return out

    def pick(self, dim: str, places: list[int]) -> Bins:
        """Bins of a dimension in rising order, numbered anew; a bin's lower edge stays, the last one's upper edge ends them.

        So bins with gaps between them reach up to the next one that was picked.
        """
        if places != sorted(set(places)):
            raise IndexError("bins are picked in rising order, each once")
        new = F.create_map(*[F.lit(x) for i, p in enumerate(places) for x in (p, i)])
        out = self.df.where(F.col(dim).isin(places)).withColumn(dim, new[F.col(dim)])
        return Bins(out, self.dims | {dim: [self.dims[dim][p] for p in places] + [self.dims[dim][places[-1] + 1]]}, self.attrs)

    def mask(self, dim: str, keep: list[bool]) -> Bins:
        """The bins of a dimension that a mask marks."""
        if len(keep) != len(self.dims[dim]) - 1 or not any(keep):
            raise ValueError("a mask marks bins, of all that there are")
        return self.pick(dim, [i for i, k in enumerate(keep) if k])

    def where(self, *conditions: Column, or_none: bool = False) -> Bins:
        """The bins of every dimension all of whose rows, over the other dimensions, meet all conditions; a bin without rows goes.

        Where no bin meets them, that is an error, or with or_none no rows, with the edges as they are.
        """
        met = F.lit(True)
        for c in conditions:
            met = met & F.coalesce(c, F.lit(False))
        # As many rows as a dimension has bins.
        kept = {dim: sorted(r[0] for r in self.df.groupBy(dim).agg(F.min(met).alias("all")).where("all").select(dim).collect()) for dim in self.dims}
        out = self
        if or_none and not all(kept.values()):
            return Bins(self.df.where("false"), self.dims, self.attrs)
        for dim, places in kept.items():
            if not places:
                raise ValueError(f"no bin of {dim} meets the conditions")
            out = out.pick(dim, places)
        return out

    def squeeze(self, dim: str | None = None) -> Bins:
        """Without a dimension of one bin, by default all such."""
        one = [d for d in self.dims if len(self.dims[d]) == 2 and dim in (None, d)]
        if not one:
            raise ValueError("no dimension of one bin")
        if len(one) == len(self.dims):
            raise ValueError("the last dimension cannot be squeezed")
        return Bins(self.df.drop(*one), {d: e for d, e in self.dims.items() if d not in one}, self.attrs)

    def copy(self) -> Bins:
        return Bins(self.df, self.dims, self.attrs)

    def with_variable(self, name: str, value: Column) -> Bins:
        if name in self.dims:
            raise ValueError(f"{name} is a dimension")
        return Bins(self.df.withColumn(name, value), self.dims, self.attrs)

    def take(self, dim: str, start: int, stop: int) -> Bins:
        """Bins start..stop-1 of a dimension, numbered anew."""
        out = self.df.where((F.col(dim) >= start) & (F.col(dim) < stop)).withColumn(dim, F.col(dim) - start)
        return Bins(out, self.dims | {dim: self.dims[dim][start : stop + 1]}, self.attrs)

    def rename(self, old: str, new: str) -> Bins:
        if old not in self.df.columns or new in self.df.columns:
            raise ValueError(f"cannot rename {old} to {new}")
        return Bins(self.df.withColumnRenamed(old, new), {new if d == old else d: e for d, e in self.dims.items()}, self.attrs)

    def reindex(self, dim: str, factor: int, weight: str | None = None, summed: tuple[str, ...] = ("modes", "npairs", "wnpairs", "n"), force: bool = False) -> Bins:
        """Merges `factor` adjacent bins: sums of count-like columns, (weighted) means of the others; a rest is an error unless forced off."""
        n = len(self.dims[dim]) - 1
        if n % factor and not force:
            raise ValueError(f"{n} bins do not divide by {factor}")
        keep = n // factor
        keys = list(self.dims)
        values = [c for c in self.df.columns if c not in keys]
        w = F.col(weight) if weight else F.lit(1.0)
        df = self.df.withColumn("_bin", F.floor(F.col(dim) / factor).cast("int")).where(F.col("_bin") < keep)
        by = [F.col("_bin").alias(dim) if k == dim else F.col(k) for k in keys]
        usable = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        aggs = [F.sum(c).alias(c) if c in summed else (F.sum(F.when(usable(c), F.col(c) * w)) / F.sum(F.when(usable(c), w))).alias(c) for c in values]
        return Bins(df.groupBy(*by).agg(*aggs), self.dims | {dim: self.dims[dim][: keep * factor + 1 : factor]}, self.attrs)

    def average(self, dim: str, weight: str | None = None) -> Bins:
        whole = self.reindex(dim, len(self.dims[dim]) - 1, weight)
        return Bins(whole.df.drop(dim), {k: v for k, v in self.dims.items() if k != dim}, self.attrs)

    def save(self, path: str) -> None:
        """The rows as Parquet, dimensions and attributes beside them as one JSON row, in any store that Spark writes."""
        self.df.write.mode("overwrite").parquet(f"{path}/rows")
        self.df.sparkSession.createDataFrame([(dumps({"dims": self.dims, "attrs": self.attrs}),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bins:
        about = loads(spark.read.text(f"{path}/about").first()[0])
        return cls(spark.read.parquet(f"{path}/rows"), about["dims"], about["attrs"])

    def to_json(self, path: str) -> None:
        """One row of JSON text, for tables of few bins."""
        held = {"dims": self.dims, "attrs": self.attrs, "columns": self.df.columns, "types": [t for _, t in self.df.dtypes], "rows": [list(r) for r in self.df.collect()]}
        self.df.sparkSession.createDataFrame([(dumps(held),)], "about string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def from_json(cls, spark: SparkSession, path: str) -> Bins:
        d = loads(spark.read.text(path, wholetext=True).first()[0])
        schema = ", ".join(f"{c} {t}" for c, t in zip(d["columns"], d["types"], strict=True))
        return cls(spark.createDataFrame([tuple(r) for r in d["rows"]], schema), d["dims"], d["attrs"])

    @classmethod
    def from_plaintext(cls, spark: SparkSession, path: str, names: list[str], dims: dict[str, list[float]], attrs: dict | None = None) -> Bins:
        """Columns of a text file with one line for each bin, the last dimension's index running fastest; bins without numbers are 'nan'."""
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", "\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))).alias("place", "line"))
        parts, size = F.split(F.regexp_replace("line", r"\s+", " "), " "), math.prod(len(e) - 1 for e in dims.values())
        if (found := lines.count()) != size:
            raise ValueError(f"{found} lines for {size} bins")
        index, after = [], size
        for dim, edges in dims.items():
            after //= len(edges) - 1
            index.append((F.floor(F.col("place") / after) % (len(edges) - 1)).cast("int").alias(dim))
        return cls(lines.select(*index, *[F.get(parts, F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)]), dims, attrs)
