"""Queries for catalogs and their files, derived columns, halo relations and tables of bins, and the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.catalog import Catalog, column
from skyloom.functions import sky
from skyloom.operators import histograms
from skyloom.operators.field import Mesh
from skyloom.plans.queries import _TWO, BOX, CUST, ORACLES, N, _two, points, points_sql, query, r
from skyloom.plans.scratch import Scratch
from skyloom.sources.files import FileCatalog, read_binary, read_csv, read_tpm, write_binary
from skyloom.sources.ranges import Field, FlatBinary

ORDERS = points_sql("orders")

# Columns and rows


class _Centred(Catalog):
    @column
    def Distance(self):
        return sky.norm(*[self[a] - BOX / 2 for a in "xyz"])

    @column
    def Heavy(self):
        return self["w"] * self["Distance"]


_DISTANCE = f"sqrt({' + '.join(f'({a} - {BOX / 2}) * ({a} - {BOX / 2})' for a in 'xyz')})"


@query(f"select id, w, round(d, 6) as Distance, round(w * d, 6) as Heavy, 1.0::double as Weight from (select *, {_DISTANCE} as d from {ORDERS}) where d < 40 and w > 1")
def derived_columns(spark, sf):
    c = _Centred(points(spark, sf, "orders"))
    near = c[(c["Distance"] < 40) & (c["w"] > 1)]
    return near[["w", "Distance", "Heavy", "Weight"]].df.select("id", "w", r("Distance").alias("Distance"), r("Heavy").alias("Heavy"), "Weight")


@query(f"select id, round(x, 9) + 0.0 as x, w * 2 as twice, 100.0::double as side from {ORDERS} where x < 50 order by id")
def saved_catalog(spark, sf):
    """A filtered catalog with columns set and dropped, written and read again with its attributes."""
    c = Catalog(points(spark, sf, "orders"), {"BoxSize": BOX})
    c = c[c["x"] < 50].with_column("twice", c["w"] * 2).drop("y")
    c.save(path := f"{Scratch(spark).root}/catalog", columns=["x", "twice"])
    again = Catalog.load(spark, path)
    return again.df.select("id", r("x", 9).alias("x"), "twice", F.lit(again.attrs["BoxSize"]).alias("side"))


@query(ORACLES["paint_cic"])
def saved_mesh(spark, sf):
    """A painted grid, written and read again as a grid."""
    src = points(spark, sf, "orders")
    Mesh.from_points(src, N, BOX).save(path := f"{Scratch(spark).root}/mesh")
    again = Mesh.load(spark, path)
    mean = again.attrs["N"] / N**3
    return again.compute().select("ix", "iy", "iz", r(F.col("v") * mean).alias("v"))


# Files

_FIELDS: list[Field] = [("Key", "<i8", 1), ("Position", "<f8", 3), ("Mass", "<f4", 1)]


def _binary(spark: SparkSession, sf: str) -> str:
    """A folder of flat binary files of the orders, in the order of their keys."""
    rows = points(spark, sf, "orders").select(F.col("id").alias("Key"), F.array(*"xyz").alias("Position"), F.col("w").cast("float").alias("Mass"))
    write_binary(rows.repartitionByRange(4, "Key").sortWithinPartitions("Key"), path := f"{Scratch(spark).root}/binary", _FIELDS, b"sixteen bytes of", rows_per_file=1000)
    return path


_NUMBERED = f"(select *, row_number() over (order by id) - 1 as place from {ORDERS})"


@query(f"select cast((place - 100) // 7 as bigint) as id, id as Key, round(y, 9) + 0.0 as y from {_NUMBERED} where place >= 100 and place < 100000 and (place - 100) % 7 = 0")
def binary_slice(spark, sf):
    """Every seventh row of a stack of files; of the columns only two are read."""
    found = read_binary(spark, _binary(spark, sf), _FIELDS, header=16, columns=["Key", "Position"], start=100, stop=100000, step=7, rows_per_task=500)
    return found.select("id", "Key", r(F.col("Position")[1], 9).alias("y"))


@query(f"select cast(place - 60 as bigint) as id, id as Key, w as Mass from {_NUMBERED} where place >= 60 and place < 110")
def binary_query_range(spark, sf):
    """A range of a range of a catalog of files."""
    c = FileCatalog(spark, FlatBinary(tuple(_FIELDS), 16), _binary(spark, sf), ["Key", "Mass"]).query_range(50, 200).query_range(10, 60)
    return c.df.select("id", "Key", F.col("Mass").cast("double").alias("Mass"))


@query(f"select id as ID, cast(cast(x as float) as double) as x, cast(cast(w * 3 as float) as double) as vz from {ORDERS}")
def tpm_rows(spark, sf):
    """Position, velocity and number behind a header of 28 bytes."""
    rows = points(spark, sf, "orders").select(*[F.array(*[e.cast("float") for e in es]).alias(n) for n, es in (("Position", [F.col(a) for a in "xyz"]), ("Velocity", [F.col("w") * i for i in (1, 2, 3)]))], F.col("id").alias("ID"))
    write_binary(rows, path := f"{Scratch(spark).root}/tpm", [("Position", "<f4", 3), ("Velocity", "<f4", 3), ("ID", "<u8", 1)], bytes(28))
    found = read_tpm(spark, path)
    return found.select("ID", F.col("Position")[0].cast("double").alias("x"), F.col("Velocity")[2].cast("double").alias("vz"))


@query(f"select id as key, round(x, 9) + 0.0 as x, w from {ORDERS} where id % 50 <> 0")
def csv_rows(spark, sf):
    """Text parted by white space, with comments and blank lines; one column is left out."""
    line = F.concat_ws("   ", "id", "x", "y", "w")
    text = points(spark, sf, "orders").select(F.when(F.col("id") % 50 == 0, F.concat(F.lit("# "), line)).when(F.col("id") % 7 == 0, F.concat(F.lit("\n  "), line)).otherwise(line))
    text.write.text(path := f"{Scratch(spark).root}/text")
    found = read_csv(spark, path, ["key", "x", "y", "w"], {"key": "bigint"}, usecols=["key", "x", "w"])
    return found.select("key", r("x", 9).alias("x"), "w")


# Halo relations and harmonics

_Z, _OMEGA, _MASS = 0.5, 0.3089, "power(10, 12 + x / 25)"
_E2 = f"({_OMEGA} * 1.5 * 1.5 * 1.5 + {1 - _OMEGA!r})"
_OM_Z = f"({_OMEGA} * 1.5 * 1.5 * 1.5 / {_E2})"
_TIMES = {"vir": f"(18 * pi() * pi() + 82 * ({_OM_Z} - 1) - 39 * ({_OM_Z} - 1) * ({_OM_Z} - 1))", "200c": "200", "200m": f"(200 * {_OM_Z})"}


@query(f"""select id, round(power(10, 0.537 + 0.488 * exp(-0.718 * power(0.5, 1.08)) - 0.085 * log10({_MASS} / 1e12)), 6) as concentration,
round(1100 * power(sqrt({_E2}) * {_MASS} / 1e15, 0.33333), 6) as dispersion, {", ".join(f"round(power(3 * {_MASS} / (4 * pi() * {t} * {sky.CRITICAL_DENSITY!r} * {_E2}), 1.0 / 3), 6) as radius_{d}" for d, t in _TIMES.items())} from {CUST}""")
def halo_relations(spark, sf):
    """Concentration, velocity dispersion and proper radius by three mass definitions."""
    mass, e = F.pow(F.lit(10.0), 12 + F.col("x") / 25), math.sqrt(_OMEGA * (1 + _Z) ** 3 + 1 - _OMEGA)
    radii = [r(sky.halo_radius_of(mass, _OMEGA, e, _Z, d)).alias(f"radius_{d}") for d in _TIMES]
    return points(spark, sf, "customer").select("id", r(sky.halo_concentration(mass, _Z)).alias("concentration"), r(sky.velocity_dispersion(mass, e)).alias("dispersion"), *radii)


_YLM = {
    (0, 0): "sqrt(1 / (4 * pi()))",
    (1, -1): "sqrt(3 / (4 * pi())) * v",
    (2, 0): "sqrt(5 / (16 * pi())) * (3 * t * t - 1)",
    (2, 1): "sqrt(15 / (4 * pi())) * u * t",
    (3, -2): "sqrt(105 / (4 * pi())) * u * v * t",
    (4, 3): "0.75 * sqrt(35 / (2 * pi())) * u * (u * u - 3 * v * v) * t",
    (4, -4): "0.75 * sqrt(35 / pi()) * u * v * (u * u - v * v)",
}


def _name(ell: int, m: int) -> str:
    return f"y{ell}_{'m' if m < 0 else ''}{abs(m)}"


@query(f"select id, {', '.join(f'round({f}, 9) + 0.0 as {_name(*lm)}' for lm, f in _YLM.items())} from (select id, (x - 50) / d as u, (y - 50) / d as v, (z - 50) / d as t from (select *, {_DISTANCE} as d from {ORDERS}))")
def real_harmonics(spark, sf):
    src = points(spark, sf, "orders")
    d = sky.norm(*[F.col(a) - 50 for a in "xyz"])
    unit = src.select("id", *[((F.col(a) - 50) / d).alias(a) for a in "xyz"])
    return unit.select("id", *[r(sky.real_ylm(*lm, F.col("x"), F.col("y"), F.col("z")), 9).alias(_name(*lm)) for lm in _YLM])


# Tables of bins


@query(f"select cast(r_bin // 2 as integer) as r_bin, cast(bin2 // 3 as integer) as bin2, npairs, wnpairs from ({_TWO}) where r_bin % 2 = 0 and bin2 in (0, 3)")
def binned_steps(spark, sf):
    """Every second bin of one dimension and a list of bins of the other."""
    return _two(spark, sf)[::2, [0, 3]].df


_MEAN = f"select r_bin, cast(sum(npairs) as bigint) as npairs, sum(wnpairs) as wnpairs, round(sum(ratio * npairs) / sum(npairs), 9) as ratio from (select *, wnpairs / npairs as ratio from ({_TWO})) group by r_bin"


def _averaged(spark, sf) -> histograms.Bins:
    two = _two(spark, sf).with_variable("mean_weight", F.col("wnpairs") / F.col("npairs")).rename("mean_weight", "ratio")
    return two.average("bin2", "npairs")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("r_bin", "npairs", "wnpairs", r("ratio", 9).alias("ratio"))


@query(_MEAN)
def binned_average(spark, sf):
    """A variable made, renamed and averaged over a dimension by its pairs."""
    return _rounded(_averaged(spark, sf).df)


@query(f"select cast(row_number() over (order by r_bin) - 1 as integer) as r_bin, npairs, wnpairs, ratio from ({_MEAN}) where npairs >= 10 and wnpairs < 1e9")
def binned_where(spark, sf):
    """The bins that meet two conditions, numbered anew."""
    return _rounded(_averaged(spark, sf).where(F.col("npairs") >= 10, F.col("wnpairs") < 1e9, or_none=True).df)


@query(f"{_MEAN} order by r_bin")
def saved_bins(spark, sf):
    """A table of bins, written as Parquet, then as one row of JSON, and read again from both."""
    root = Scratch(spark).root
    _averaged(spark, sf).save(f"{root}/bins")
    histograms.Bins.load(spark, f"{root}/bins").to_json(f"{root}/json")
    return _rounded(histograms.Bins.from_json(spark, f"{root}/json").df)
