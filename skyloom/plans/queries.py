"""Queries for the library's own operators over the driver's tables, and the same in DuckDB SQL.

Positions come from integer keys (see catalog.positions), box side 100. Values that are sums of
doubles are rounded on both sides, as the order of a sum is free.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.catalog import Catalog, position_sql, positions, species, stack
from skyloom.functions import sky
from skyloom.functions.cosmology import Cosmology, comoving_to_sky, sky_to_comoving
from skyloom.operators import groups, histograms, mocks, paircount, power
from skyloom.operators import mesh as M
from skyloom.operators.field import Mesh
from skyloom.operators.numbering import dense_index

BOX, N = 100.0, 8
QUERIES, ORACLES = {}, {}
TABLES = {"orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str, name: str, *more: Column) -> DataFrame:
    key = TABLES[name]
    return table(spark, sf, name).select(F.col(key).cast("long").alias("id"), *positions(f"cast({key} as bigint)", BOX), (F.col(key) % 4 + 1).cast("double").alias("w"), *more)


def points_sql(name: str, more: str = "") -> str:
    key = TABLES[name]
    cols = ", ".join(f"{position_sql(f'cast({key} as bigint)', a, BOX)} as {a}" for a in "xyz")
    return f"(select cast({key} as bigint) as id, {cols}, cast({key} % 4 + 1 as double) as w{more} from {name})"


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


# Rows and columns


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net from lineitem where l_quantity >= 25 and l_discount < 0.05")
def scan_project_filter(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.where((F.col("l_quantity") >= 25) & (F.col("l_discount") < 0.05)).select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query(f"select id, w from {points_sql('orders')} where id >= 7 and id < 1400 and (id - 7) % 5 = 0")
def global_slice(spark, sf):
    return Catalog(points(spark, sf, "orders"))[7:1400:5].df.select("id", "w")


@query("""select o_orderkey, o_totalprice, place from (select *, row_number() over (order by o_totalprice, o_orderkey) - 1 as place from orders where o_custkey % 3 = 0) where place >= 5 and place < (select count(*) from orders where o_custkey % 3 = 0) - 7 and (place - 5) % 4 = 0
union all select o_orderkey, o_totalprice, place from (select *, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as place from orders where o_custkey % 3 = 0) where place in (0, 3)""")
def positions_after_filter_and_sort(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderkey", "o_custkey", "o_totalprice")
    some = Catalog(t)[F.col("o_custkey") % 3 == 0]
    middle, top = some.sort("o_totalprice")[5:-7:4], some.sort("o_totalprice", reverse=True)[[0, 3]]
    # The list's own places are 0 and 1.
    ends = top.df.withColumn("id", F.col("id") * 3)
    return middle.df.unionByName(ends).select("o_orderkey", "o_totalprice", F.col("id").alias("place"))


@query("select o_custkey, o_orderkey, row_number() over (order by o_custkey, o_totalprice, o_orderkey) as place from orders qualify place <= 100")
def multi_key_sort_top(spark, sf):
    t = table(spark, sf, "orders").withColumn("id", F.col("o_orderkey"))
    top = Catalog(t).sort(["o_custkey", "o_totalprice"]).df.limit(100)  # a top-k report
    from pyspark.sql import Window

    return top.select("o_custkey", "o_orderkey", F.row_number().over(Window.orderBy("o_custkey", "o_totalprice", "o_orderkey")).cast("long").alias("place"))


@query(f"select id, w from {points_sql('customer')} union all select id + (select count(*) from customer) as id, w from {points_sql('supplier')}")
def concat_sources(spark, sf):
    return Catalog(points(spark, sf, "customer")).concat(Catalog(points(spark, sf, "supplier")), columns=["w"]).df


@query("select p_partkey, cast(p_size as double) as first, p_retailprice as second, true as selection, 1.0::double as weight from part")
def stack_constant_default_columns(spark, sf):
    c = Catalog(table(spark, sf, "part").withColumn("id", F.col("p_partkey")))
    s = stack(F.col("p_size").cast("double"), F.col("p_retailprice"))
    return c.df.select("p_partkey", s[0].alias("first"), s[1].alias("second"), c["Selection"].alias("selection"), c["Weight"].alias("weight"))


@query(f"select 'c' as species, count(*) as n, sum(w) as w from {points_sql('customer')} union all select 's', count(*), sum(w) from {points_sql('supplier')}")
def multiple_species(spark, sf):
    return species(c=Catalog(points(spark, sf, "customer")), s=Catalog(points(spark, sf, "supplier"))).df.groupBy("species").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


@query("select l_orderkey, l_linenumber, dense_rank() over (order by l_suppkey, l_quantity) - 1 as label from lineitem")
def distributed_dense_labels(spark, sf):
    return groups.dense_labels(table(spark, sf, "lineitem"), ["l_suppkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "label")


# Coordinates


@query(f"select id, round(cos(radians(y * 1.8 - 90)) * cos(radians(x * 3.6)), 9) + 0.0 as ux, round(cos(radians(y * 1.8 - 90)) * sin(radians(x * 3.6)), 9) + 0.0 as uy, round(sin(radians(y * 1.8 - 90)), 9) + 0.0 as uz from {points_sql('customer')}")
def sky_to_unit_sphere(spark, sf):
    u = sky.to_unit_sphere(F.col("x") * 3.6, F.col("y") * 1.8 - 90)
    return points(spark, sf, "customer").select("id", *[r(c, 9).alias(f"u{a}") for a, c in zip("xyz", u, strict=True)])


@query(f"select id, round(case when a < 0 then a + 360 else a end, 8) + 0.0 as ra, round(degrees(atan2(z - 50, sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50)))), 8) + 0.0 as dec from (select *, degrees(atan2(y - 50, x - 50)) as a from {points_sql('customer')})")
def cartesian_to_equatorial(spark, sf):
    ra, dec = sky.to_equatorial(F.col("x"), F.col("y"), F.col("z"), (50.0, 50.0, 50.0))
    return points(spark, sf, "customer").select("id", r(ra, 8).alias("ra"), r(dec, 8).alias("dec"))


@query(f"select id, round((x + 2 * y + 2 * z) / 9, 8) + 0.0 as px, round((x + 2 * y + 2 * z) / 9 * 2, 8) + 0.0 as py, round(z * (1.5 / (100 * 1.3)), 8) + 0.0 as offset_z from {points_sql('supplier')}")
def vector_projection_rsd(spark, sf):
    p = sky.project((F.col("x"), F.col("y"), F.col("z")), (1.0, 2.0, 2.0))
    return points(spark, sf, "supplier").select("id", r(p[0], 8).alias("px"), r(p[1], 8).alias("py"), r(sky.redshift_offset(F.col("z"), 0.5, 1.3), 8).alias("offset_z"))


@query("select p_partkey, 1.0 / (1.0 + 10000.0::double * (p_size * 1e-5::double)) as weight from part")
def fkp_weight(spark, sf):
    return table(spark, sf, "part").select("p_partkey", sky.fkp_weight(F.col("p_size") * 1e-5, 1e4).alias("weight"))


@query(f"select id, round(x - y - 100 * round((x - y) / 100, 0), 9) + 0.0 as d from {points_sql('customer')}")
def minimum_image(spark, sf):
    return points(spark, sf, "customer").select("id", r(sky.minimum_image(F.col("x") - F.col("y"), BOX), 9).alias("d"))


# Grids


def paint_sql(src: str, window: str, mass: str = "1.0::double", shift: float = 0.0, n: int = N) -> str:
    """Painted cells by cross joining every point with its stencil."""
    p = M.ORDERS[window]
    part = ", ".join(f"{a} * {n / BOX!r} + {shift} as s{a}" for a in "xyz")
    idx = ", ".join(f"({M.first_sql(p, f's{a}')} + o{a}.o) as j{a}" for a in "xyz")
    wsql = " * ".join(M.window_sql(p, f"abs(s{a} - j{a})").replace("1.0D", "1.0::double") for a in "xyz")
    stencil = f"(select unnest(range(0, {p})) as o)"
    return f"""select cast(((jx % {n}) + {n}) % {n} as integer) as ix, cast(((jy % {n}) + {n}) % {n} as integer) as iy, cast(((jz % {n}) + {n}) % {n} as integer) as iz, sum({wsql} * m) as v
from (select *, {idx} from (select {part}, {mass} as m from {src}) p cross join {stencil} ox cross join {stencil} oy cross join {stencil} oz) q group by 1, 2, 3"""


def _rounded(sql: str) -> str:
    return f"select ix, iy, iz, round(v, 6) + 0.0 as v from ({sql})"


def _paint(window: str):
    def run(spark, sf):
        return M.paint(points(spark, sf, "orders"), N, BOX, window).withColumn("v", r("v"))

    run.__name__ = f"paint_{window}"
    return query(_rounded(paint_sql(points_sql("orders"), window)))(run)


for _w in M.ORDERS:
    _paint(_w)


@query(_rounded(paint_sql(f"(select * from {points_sql('orders')} where id % 3 <> 0)", "cic", "w * 2")))
def paint_weighted_value_selection(spark, sf):
    return M.paint(points(spark, sf, "orders"), N, BOX, "cic", F.col("w"), 2.0, F.col("id") % 3 != 0).withColumn("v", r("v"))


@query(_rounded(f"select ix, iy, iz, sum(v) as v from (({paint_sql(points_sql('orders'), 'cic')}) union all ({paint_sql(points_sql('customer'), 'cic', 'w')})) group by 1, 2, 3"))
def paint_multispecies(spark, sf):
    both = points(spark, sf, "orders").withColumn("w", F.lit(1.0)).unionByName(points(spark, sf, "customer"))
    return M.paint(both, N, BOX, "cic", F.col("w")).withColumn("v", r("v"))


@query(f"select ix, iy, round(sum(v), 6) + 0.0 as v from ({paint_sql(points_sql('orders'), 'cic')}) group by 1, 2")
def mesh_preview(spark, sf):
    return M.preview(M.paint(points(spark, sf, "orders"), N, BOX, "cic"), "xy").withColumn("v", r("v"))


@query(f"""with mesh as ({paint_sql(points_sql('orders'), 'cic')}),
at as materialized (select id, cast((({M.first_sql(2, 'sx')} + a.o) % {N} + {N}) % {N} as integer) as ix, cast((({M.first_sql(2, 'sy')} + b.o) % {N} + {N}) % {N} as integer) as iy, cast((({M.first_sql(2, 'sz')} + c.o) % {N} + {N}) % {N} as integer) as iz,
 (1 - abs(sx - ({M.first_sql(2, 'sx')} + a.o))) * (1 - abs(sy - ({M.first_sql(2, 'sy')} + b.o))) * (1 - abs(sz - ({M.first_sql(2, 'sz')} + c.o))) as wt
 from (select id, x * 0.08 as sx, y * 0.08 as sy, z * 0.08 as sz from {points_sql('customer')}) p cross join range(2) a(o) cross join range(2) b(o) cross join range(2) c(o))
select id, round(sum(wt * coalesce(v, 0)), 6) + 0.0 as v from "at" left join mesh using (ix, iy, iz) group by id""".replace("at as materialized", '"at" as materialized'))
def readout_cic(spark, sf):
    mesh = M.paint(points(spark, sf, "orders"), N, BOX, "cic")
    return M.readout(points(spark, sf, "customer"), mesh, N, BOX).withColumn("v", r("v"))


# Fourier space: the oracle is the direct transform of the painted cells


def modes_sql(cells: str) -> str:
    return f"""select mx as ix, my as iy, mz as iz, case when mx > {N // 2} then mx - {N} else mx end as nx, case when my > {N // 2} then my - {N} else my end as ny, mz as nz,
  case when mz > 0 and mz < {N // 2} then 2 else 1 end as h,
  sum(v * cos({2 * math.pi / N!r} * (mx * ix + my * iy + mz * iz))) / {N**3} as re, -sum(v * sin({2 * math.pi / N!r} * (mx * ix + my * iy + mz * iz))) / {N**3} as im
from ({cells}) c cross join (select cast(unnest(range(0, {N})) as integer) as mx) a cross join (select cast(unnest(range(0, {N})) as integer) as my) b cross join (select cast(unnest(range(0, {N // 2 + 1})) as integer) as mz) d group by mx, my, mz"""


def density_sql(src: str, window: str = "cic", shift: float = 0.0) -> str:
    return f"select ix, iy, iz, v * {N**3} / (select count(*) from {src}) as v from ({paint_sql(src, window, shift=shift)})"


K0 = 2 * math.pi / BOX
EDGES = power.k_edges(N, BOX)


def bins_sql(power_modes: str, extra: str = "") -> str:
    """Averages by k bins of modes (n2, nz, h, re)."""
    edge = " + ".join(f"cast(n2 >= {e:.17e} as integer)" for e in power.squared_edges(EDGES, BOX))
    return f"select *, {edge} - 1 as k_bin, case when n2 = 0 then 0 else nz / sqrt(n2) end as mu{extra} from ({power_modes})"


def auto_sql(modes: str, factor: str = "1") -> str:
    return f"select ix, iy, iz, nx, ny, nz, h, nx * nx + ny * ny + nz * nz as n2, case when nx * nx + ny * ny + nz * nz = 0 then 0 else (re * re + im * im) * {BOX**3} * ({factor}) end as re from ({modes})"


def mean_sql(binned: str, more: str = "", keys: str = "k_bin") -> str:
    return f"select {keys}, round(sum(h * sqrt(n2)) * {K0!r} / sum(h), 6) + 0.0 as k, round(sum(h * re) / sum(h), 4) + 0.0 as power, cast(sum(h) as bigint) as modes{more} from ({binned}) where k_bin >= 0 and k_bin < {len(EDGES) - 1} group by {keys}"


def _field(spark, sf, name: str = "orders", window: str = "cic", shift: float = 0.0) -> DataFrame:
    src = points(spark, sf, name)
    mesh = M.paint(src, N, BOX, window, shift=shift)
    return M.fft(mesh.crossJoin(F.broadcast(src.agg(F.count("*").alias("total")))).select(*M.CELL, (F.col("v") * N**3 / F.col("total")).alias("v")), N)


def _power(spark, sf, modes: DataFrame, **more) -> DataFrame:
    p = power.bin_modes(power.power_modes(modes, None, BOX**3), N, BOX, EDGES, **more)
    keys = [c for c in ("k_bin", "mu_bin") if c in p.columns]
    rest = [c for c in p.columns if c.startswith("power_")]
    return p.select(*keys, r("k").alias("k"), r("power", 4).alias("power"), "modes", *[r(c, 4).alias(c) for c in rest])


CIC_MODES = modes_sql(density_sql(points_sql("orders")))


@query(f"select ix, iy, iz, round(re, 8) + 0.0 as re, round(im, 8) + 0.0 as im from ({CIC_MODES})")
def fft_modes(spark, sf):
    return _field(spark, sf).select(*M.CELL, r("re", 8).alias("re"), r("im", 8).alias("im"))


@query(mean_sql(bins_sql(auto_sql(CIC_MODES))))
def power_1d(spark, sf):
    return _power(spark, sf, _field(spark, sf))


MU = [-1.0, -0.6, -0.2, 0.2, 0.6, 1.0]


@query(mean_sql(f"select *, least({' + '.join(f'cast(mu >= {e} as integer)' for e in MU)} - 1, {len(MU) - 2}) as mu_bin from ({bins_sql(auto_sql(CIC_MODES))})", keys="k_bin, mu_bin"))
def power_2d(spark, sf):
    return _power(spark, sf, _field(spark, sf), mu_edges=MU)


@query(mean_sql(bins_sql(auto_sql(CIC_MODES)), ", round(sum(h * re) / sum(h), 4) + 0.0 as power_0, round(5 * sum(h * re * (3 * mu * mu - 1) / 2) / sum(h), 4) + 0.0 as power_2, round(9 * sum(h * re * (35 * mu * mu * mu * mu - 30 * mu * mu + 3) / 8) / sum(h), 4) + 0.0 as power_4"))
def power_poles(spark, sf):
    return _power(spark, sf, _field(spark, sf), poles=(0, 2, 4))


@query(mean_sql(bins_sql(f"select a.nx, a.ny, a.nz, a.h, a.nx * a.nx + a.ny * a.ny + a.nz * a.nz as n2, case when a.nx = 0 and a.ny = 0 and a.nz = 0 then 0 else (a.re * b.re + a.im * b.im) * {BOX**3} end as re from ({CIC_MODES}) a join ({modes_sql(density_sql(points_sql('customer')))}) b using (ix, iy, iz)")))
def power_cross(spark, sf):
    p = power.power_modes(_field(spark, sf), _field(spark, sf, "customer"), BOX**3)
    return power.bin_modes(p, N, BOX, EDGES).select("k_bin", r("k").alias("k"), r("power", 4).alias("power"), "modes")


@query(f"select n2, round(sqrt(n2) * {K0!r}, 6) as k, round(sum(h * re) / sum(h), 4) + 0.0 as power, cast(sum(h) as bigint) as modes from ({auto_sql(CIC_MODES)}) group by n2")
def power_unique_k(spark, sf):
    return power.unique_k(power.power_modes(_field(spark, sf), None, BOX**3), N, BOX).select("n2", r("k").alias("k"), r("power", 4).alias("power"), "modes")


def _sin2(c: str) -> str:
    return f"(sin({math.pi / N!r} * {c}) * sin({math.pi / N!r} * {c}))"


@query(mean_sql(bins_sql(auto_sql(CIC_MODES, "1.0 / (" + " * ".join(f"(1 - 2.0 / 3 * {_sin2(c)})" for c in ("nx", "ny", "nz")) + ")"))))
def power_compensated(spark, sf):
    return _power(spark, sf, M.compensate(_field(spark, sf), N, BOX, "cic"))


_PHASE = f"({math.pi / N!r} * (a.nx + a.ny + a.nz))"


@query(mean_sql(bins_sql(auto_sql(f"select a.ix, a.iy, a.iz, a.nx, a.ny, a.nz, a.h, 0.5 * (a.re + b.re * cos{_PHASE} - b.im * sin{_PHASE}) as re, 0.5 * (a.im + b.re * sin{_PHASE} + b.im * cos{_PHASE}) as im from ({CIC_MODES}) a join ({modes_sql(density_sql(points_sql('orders'), shift=0.5))}) b using (ix, iy, iz)"))))
def power_interlaced(spark, sf):
    return _power(spark, sf, M.interlace(_field(spark, sf), _field(spark, sf, shift=0.5), N, BOX))


@query(mean_sql(bins_sql(auto_sql(CIC_MODES, f"exp(-(nx * nx + ny * ny + nz * nz) * {K0**2 * 100:.17e})"))))
def filter_gaussian(spark, sf):
    return _power(spark, sf, M.apply_filter(_field(spark, sf), N, BOX, lambda k: sky.gaussian(k, 10.0)))


_KR = f"(sqrt(nx * nx + ny * ny + nz * nz) * {K0 * 10!r})"


@query(mean_sql(bins_sql(auto_sql(CIC_MODES, f"power(case when nx = 0 and ny = 0 and nz = 0 then 1 else 3 * (sin{_KR} / power({_KR}, 3) - cos{_KR} / power({_KR}, 2)) end, 2)"))))
def filter_top_hat(spark, sf):
    return _power(spark, sf, M.apply_filter(_field(spark, sf), N, BOX, lambda k: sky.top_hat(k, 10.0)))


@query(f"select ix, iy, iz, round(-im * m * {K0!r}, 8) + 0.0 as re, round(re * m * {K0!r}, 8) + 0.0 as im from (select *, case when nx = {N // 2} then -nx else nx end as m from ({modes_sql(f'select ix, iy, iz, v * (ix + 1) as v from ({density_sql(points_sql("orders"))})')}))")
def mesh_queued_filters(spark, sf):
    mesh = Mesh.from_points(points(spark, sf, "orders"), N, BOX)
    mesh = mesh.apply(lambda x, y, z: x + 1, "index", "real").apply(lambda x, y, z: (F.lit(0.0), x))
    return mesh.compute("complex").select(*M.CELL, r("re", 8).alias("re"), r("im", 8).alias("im"))


_PLANE = f"""select mx, my, case when mx > {N // 2} then mx - {N} else mx end as nx, my as ny, case when my > 0 and my < {N // 2} then 2 else 1 end as h,
  sum(v * cos({2 * math.pi / N!r} * (mx * ix + my * iy))) / {N**2} as re, sum(v * sin({2 * math.pi / N!r} * (mx * ix + my * iy))) / {N**2} as im
from ({paint_sql(points_sql("orders"), "cic")}) c cross join (select cast(unnest(range(0, {N})) as integer) as mx) a cross join (select cast(unnest(range(0, {N // 2 + 1})) as integer) as my) b group by mx, my"""


@query(mean_sql(bins_sql(f"select h, nx * nx + ny * ny as n2, 0 as nz, case when nx = 0 and ny = 0 then 0 else (re * re + im * im) * {BOX**2} end as re from ({_PLANE})")))
def power_projected(spark, sf):
    p = power.projected_power(M.paint(points(spark, sf, "orders"), N, BOX, "cic"), N, BOX)
    return p.select("k_bin", r("k").alias("k"), r("power", 4).alias("power"), "modes")


CEDGES = [1.0, 15.0, 30.0, 45.0]
_CELLS = " cross join ".join(f"(select cast(unnest(range(0, {N})) as integer) as {c}) {c}s" for c in ("cx", "cy", "cz"))
_NEAR = ", ".join(f"case when {c} > {N // 2} then {c} - {N} else {c} end as d{c[1]}" for c in ("cx", "cy", "cz"))


@query(f"""select r_bin, round(avg(r), 6) as r, round(avg(v), 8) + 0.0 as corr, count(*) as modes, round(avg(v), 8) + 0.0 as corr_0, round(avg(v * 5 * (3 * mu * mu - 1) / 2), 8) + 0.0 as corr_2
from (select *, {" + ".join(f"cast(r >= {e} as integer)" for e in CEDGES)} - 1 as r_bin, case when r = 0 then 0 else abs(dz) * {BOX / N} / r end as mu from (select *, sqrt(dx * dx + dy * dy + dz * dz) * {BOX / N} as r from (select {_NEAR}, v from (
  select cx, cy, cz, sum(h * re * cos({2 * math.pi / N!r} * (ix * cx + iy * cy + iz * cz))) / {BOX**3} as v from ({auto_sql(CIC_MODES)}) m cross join {_CELLS} group by cx, cy, cz))))
where r_bin between 0 and {len(CEDGES) - 2} group by r_bin""")
def fft_corr(spark, sf):
    c = power.correlation(power.power_modes(_field(spark, sf), None, BOX**3), N, BOX, CEDGES, poles=(0, 2))
    return c.select("r_bin", r("r").alias("r"), r("corr", 8).alias("corr"), "modes", r("corr_0", 8).alias("corr_0"), r("corr_2", 8).alias("corr_2"))


def _survey(spark, sf) -> power.Survey:
    data, randoms = [points(spark, sf, name).select("id", "x", "y", "z", F.lit(1e-3).alias("NZ"), F.col("w").alias("Weight"), sky.fkp_weight(F.lit(1e-3), 1e4).alias("FKPWeight")) for name in ("customer", "orders")]
    return power.Survey(data, randoms)


_FKP = 1 / (1 + 1e4 * 1e-3)


@query(f"""select round(d.w / r.w, 9) as alpha, round(d.w / r.w * r.w * {1e-3 * _FKP**2!r}, 9) as norm, round((d.w2 * {_FKP**2!r} + d.w / r.w * d.w / r.w * r.w2 * {_FKP**2!r}) / (d.w / r.w * r.w * {1e-3 * _FKP**2!r}), 4) as shotnoise
from (select sum(w) as w, sum(w * w) as w2 from {points_sql('customer')}) d cross join (select sum(w) as w, sum(w * w) as w2 from {points_sql('orders')}) r""")
def convpower_norm_shotnoise(spark, sf):
    s = power.survey_sums(_survey(spark, sf))
    return s.select(r("alpha", 9).alias("alpha"), r("randoms_norm", 9).alias("norm"), r("shotnoise", 4).alias("shotnoise"))


# Histograms


@query(" union all ".join(f"select '{a}' as axis, min({a}) as lo, max({a}) as hi, (min({a}) + max({a})) / 2 as centre, ceil((max({a}) - min({a})) * (1 + 0.02)) as box from {points_sql('orders')}" for a in "xyz"))
def bounds_bbox(spark, sf):
    return histograms.bounds(points(spark, sf, "orders"))


ZEDGES = [i * 0.1 for i in range(1, 10)]
_CHI = Cosmology().comoving_distance(ZEDGES)
_DV = [4 / 3 * math.pi * 0.25 * (b**3 - a**3) for a, b in zip(_CHI[:-1], _CHI[1:], strict=True)]


@query(f"""select e.bin, coalesce(n, 0) as n, round(coalesce(n, 0) / e.dv * 1e9, 6) as nz from (values {", ".join(f"({i}, {float(v)!r}::double)" for i, v in enumerate(_DV))}) e(bin, dv)
left join (select {" + ".join(f"cast(value / 500 >= {e!r}::double as integer)" for e in ZEDGES)} - 1 as bin, count(*)::double as n from events group by 1) c on e.bin = c.bin""")
def redshift_hist(spark, sf):
    t = table(spark, sf, "events").select((F.col("value") / 500).alias("z"))
    return histograms.redshift_histogram(t, "z", ZEDGES, 0.25, Cosmology()).select("bin", "n", F.round(F.col("nz") * 1e9, 6).alias("nz"))


@query(f"select round(stddev_pop(value) * power({24 * math.sqrt(math.pi)!r} / count(*), 1.0 / 3), 6) as width, cast(greatest(1, ceil((max(value) - min(value)) / (stddev_pop(value) * power({24 * math.sqrt(math.pi)!r} / count(*), 1.0 / 3)))) as bigint) as bins from events")
def scott_bins(spark, sf):
    return histograms.scott(table(spark, sf, "events"), "value").select(F.round("width", 6).alias("width"), "bins")


# Pairs

REDGES = [2.0, 4.0, 6.0, 8.0, 10.0]


def pair_sql(a: str, b: str, where: str, s: str, extra: str = "", keys: str = "", periodic: bool = True, edges: list[float] = REDGES) -> str:
    gap = ", ".join(f"a.{c} - b.{c} - {f'{BOX} * round((a.{c} - b.{c}) / {BOX}, 0)' if periodic else '0'} as d{c}, a.{c} + b.{c} as m{c}" for c in "xyz")
    at = " + ".join(f"cast(s >= {e} as integer)" for e in edges)
    return f"select r_bin{keys}, count(*) as npairs, sum(ww) as wnpairs, round(avg(s), 6) as r from (select *, {at} - 1 as r_bin{extra} from (select *, {s} as s from (select a.w * b.w as ww, {gap} from {a} a join {b} b on {where}))) where r_bin between 0 and {len(edges) - 2}{' and bin2 is not null' if keys else ''} group by r_bin{keys}"


S3 = "sqrt(dx * dx + dy * dy + dz * dz)"
CUST = points_sql("customer")


def _pairs(df: DataFrame) -> DataFrame:
    return df.withColumn("r", F.round("r", 6))


@query(pair_sql(CUST, CUST, "a.id <> b.id", S3))
def pairs_1d(spark, sf):
    return _pairs(paircount.box_pairs(points(spark, sf, "customer"), REDGES, BOX, weight="w"))


@query(pair_sql(CUST, CUST, "a.id <> b.id", S3, ", cast(least(floor(abs(dz) / s * 4), 3) as integer) as bin2", ", bin2"))
def pairs_2d(spark, sf):
    return _pairs(paircount.box_pairs(points(spark, sf, "customer"), REDGES, BOX, mode="2d", n_mu=4, weight="w"))


@query(pair_sql(CUST, CUST, "a.id <> b.id", "sqrt(dx * dx + dy * dy)", ", case when abs(dz) < 5 then cast(floor(abs(dz)) as integer) end as bin2", ", bin2"))
def pairs_projected(spark, sf):
    return _pairs(paircount.box_pairs(points(spark, sf, "customer"), REDGES, BOX, mode="projected", pimax=5.0, weight="w"))


@query(pair_sql(CUST, points_sql("supplier"), "true", S3))
def pairs_cross(spark, sf):
    return _pairs(paircount.box_pairs(points(spark, sf, "customer"), REDGES, BOX, points(spark, sf, "supplier"), weight="w"))


@query(pair_sql(CUST, CUST, "a.id <> b.id", S3, periodic=False))
def pairs_nonperiodic(spark, sf):
    return _pairs(paircount.box_pairs(points(spark, sf, "customer"), REDGES, None, weight="w"))


@query(pair_sql(CUST, CUST, "a.id <> b.id", S3, ", cast(least(floor(abs(dx * mx + dy * my + dz * mz) / sqrt(mx * mx + my * my + mz * mz) / s * 4), 3) as integer) as bin2", ", bin2", periodic=False))
def pairs_survey(spark, sf):
    return _pairs(paircount.survey_pairs(points(spark, sf, "customer"), REDGES, mode="2d", n_mu=4, weight="w"))


# A universe of matter alone has its distances in closed form.
_MATTER = Cosmology(omega_m=1.0)
_REACH = repr(2 * sky.LIGHT_SPEED / 100)


def _on_sky(spark, sf, name: str) -> DataFrame:
    return points(spark, sf, name).select("id", "w", (F.col("x") * 0.5).alias("ra"), (F.col("y") * 0.5 - 25).alias("dec"), ((F.col("z") + 20) / 3000).alias("redshift"))


def comoving_sql(name: str) -> str:
    found = f"select id, w, radians(x * 0.5) as a, radians(y * 0.5 - 25) as b, {_REACH} * (1 - 1 / sqrt(1 + (z + 20) / 3000)) as d from {points_sql(name)}"
    return f"(select id, w, d * cos(b) * cos(a) as x, d * cos(b) * sin(a) as y, d * sin(b) as z from ({found}))"


@query(f"select id, round(x, 4) + 0.0 as x, round(y, 4) + 0.0 as y, round(z, 4) + 0.0 as z from {comoving_sql('orders')}")
def sky_to_comoving_positions(spark, sf):
    src = _on_sky(spark, sf, "orders")
    at = sky_to_comoving(_MATTER, F.col("ra"), F.col("dec"), F.col("redshift"))
    return src.select("id", *[r(c, 4).alias(a) for c, a in zip(at, "xyz", strict=True)])


_SEEN = f"select id, x, y, z, d, power(1 - d / {_REACH}, -2) - 1 as z0 from (select *, sqrt(x * x + y * y + z * z) as d from {points_sql('orders')})"


@query(f"select id, case when d = 0 then 0 else round(((degrees(atan2(y, x)) % 360) + 360) % 360, 6) + 0.0 end as ra, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) + 0.0 as dec, round(z0 + coalesce((x * 30 + y * 20 - z * 10) / nullif(d, 0), 0) / {sky.LIGHT_SPEED!r} * (1 + z0), 8) + 0.0 as redshift from ({_SEEN})")
def comoving_positions_to_sky(spark, sf):
    ra, dec, z = comoving_to_sky(_MATTER, *(F.col(a) for a in "xyz"), velocity=(F.lit(30.0), F.lit(20.0), F.lit(-10.0)))
    return points(spark, sf, "orders").select("id", r(ra).alias("ra"), r(dec).alias("dec"), r(z, 8).alias("redshift"))


@query(pair_sql(comoving_sql("customer"), comoving_sql("customer"), "a.id <> b.id", S3, ", cast(least(floor(abs(dx * mx + dy * my + dz * mz) / sqrt(mx * mx + my * my + mz * mz) / s * 4), 3) as integer) as bin2", ", bin2", periodic=False))
def pairs_survey_redshifts(spark, sf):
    return _pairs(paircount.survey_pairs(_on_sky(spark, sf, "customer"), REDGES, mode="2d", n_mu=4, weight="w", cosmo=_MATTER))


_SKY = f"(select id, w, cos(radians(y * 1.8 - 90)) * cos(radians(x * 3.6)) as x, cos(radians(y * 1.8 - 90)) * sin(radians(x * 3.6)) as y, sin(radians(y * 1.8 - 90)) as z from {CUST})"


@query(pair_sql(_SKY, _SKY, "a.id <> b.id", f"degrees(2 * asin(least({S3} / 2, 1)))", periodic=False, edges=[1.0, 2.0, 4.0]))
def pairs_angular(spark, sf):
    src = points(spark, sf, "customer").select("id", "w", (F.col("x") * 3.6).alias("ra"), (F.col("y") * 1.8 - 90).alias("dec"))
    return _pairs(paircount.angular_pairs(src, [1.0, 2.0, 4.0], weight="w"))


_ONE = pair_sql(CUST, CUST, "a.id <> b.id", S3)
_SHELL = "[" + ", ".join(repr(4 / 3 * math.pi * (b**3 - a**3)) for a, b in zip(REDGES[:-1], REDGES[1:], strict=True)) + "]"


@query(f"select r_bin, npairs, round(npairs / ({_SHELL}[r_bin + 1] * n * (n - 1) / {BOX**3}) - 1, 6) + 0.0 as corr from ({_ONE}) cross join (select count(*)::double as n from customer)")
def tpcf_natural(spark, sf):
    src = points(spark, sf, "customer")
    c = paircount.box_pairs(src, REDGES, BOX, means=False)
    return paircount.natural(c, src.count(), BOX, REDGES).select("r_bin", "npairs", r("corr").alias("corr"))


def _ls(spark, sf, **mode) -> DataFrame:
    d, ran = points(spark, sf, "customer"), points(spark, sf, "supplier")
    dd, dr, rr = (paircount.box_pairs(x, REDGES, BOX, y, weight="w", means=False, **mode) for x, y in ((d, None), (d, ran), (ran, None)))
    totals = paircount.total_weight(d, weight="w"), paircount.total_weight(d, ran, "w"), paircount.total_weight(ran, weight="w")
    return paircount.landy_szalay(dd, dr, rr, *totals)


def ls_sql(extra: str = "", keys: str = "", s: str = S3) -> str:
    sup = points_sql("supplier")
    dd, dr, rr = pair_sql(CUST, CUST, "a.id <> b.id", s, extra, keys), pair_sql(CUST, sup, "true", s, extra, keys), pair_sql(sup, sup, "a.id <> b.id", s, extra, keys)
    using = "using (r_bin" + keys + ")"
    return f"""select r_bin{keys}, case when rr.wnpairs > 0 then (coalesce(dd.wnpairs, 0) / tdd - 2 * coalesce(dr.wnpairs, 0) / tdr) / (rr.wnpairs / trr) + 1 end as corr
from ({rr}) rr full join ({dd}) dd {using} full join ({dr}) dr {using} cross join
(select d.w * d.w - d.w2 as tdd, d.w * r.w as tdr, r.w * r.w - r.w2 as trr from (select sum(w) as w, sum(w * w) as w2 from {CUST}) d cross join (select sum(w) as w, sum(w * w) as w2 from {sup}) r)"""


@query(f"select r_bin, round(corr, 6) + 0.0 as corr from ({ls_sql()})")
def tpcf_landy_szalay(spark, sf):
    return _ls(spark, sf).select("r_bin", r("corr").alias("corr"))


_PI = ", case when abs(dz) < 5 then cast(floor(abs(dz)) as integer) end as bin2"


@query(f"select r_bin, round(sum(2 * corr), 6) + 0.0 as wp from ({ls_sql(_PI, ', bin2', 'sqrt(dx * dx + dy * dy)')}) group by r_bin")
def tpcf_wp(spark, sf):
    return paircount.wp(_ls(spark, sf, mode="projected", pimax=5.0)).select("r_bin", r("wp").alias("wp"))


_MU2 = ", cast(least(floor(abs(dz) / s * 2), 1) as integer) as bin2"


@query(f"select r_bin, round(sum(corr) / 2, 6) + 0.0 as corr_0, round(5 * sum(corr * (3 * (bin2 + 0.5) / 2 * (bin2 + 0.5) / 2 - 1) / 2) / 2, 6) + 0.0 as corr_2 from ({ls_sql(_MU2, ', bin2')}) group by r_bin")
def tpcf_poles(spark, sf):
    return paircount.corr_poles(_ls(spark, sf, mode="2d", n_mu=2), 2, (0, 2)).select("r_bin", r("corr_0").alias("corr_0"), r("corr_2").alias("corr_2"))


TEDGES = [0.0, 8.0, 14.0]


def triplet_sql(src: str, dist: str, periodic: bool, edges: list[float], norm: str = "") -> str:
    """Triplets one by one: pairs joined with pairs of the same primary."""
    gap = ", ".join(f"a.{c} - b.{c} - {f'{BOX} * round((a.{c} - b.{c}) / {BOX}, 0)' if periodic else '0'} as d{c}" for c in "xyz")
    at = " + ".join(f"cast(s > {e} as integer)" for e in edges)
    return f"""with p as (select *, {at} - 1 as b from (select *, {dist} as s from (select a.id as i, a.w as w1, b.w as w2, {gap} from {src} a join {src} b on a.id <> b.id)) where s > 0 and s <= {edges[-1]})
select p.b as b1, q.b as b2, round(sum(p.w1 * p.w2 * q.w2) / {(4 * math.pi) ** 2!r}{norm}, 4) + 0.0 as zeta_0, round(5 * sum(p.w1 * p.w2 * q.w2 * (3 * m * m - 1) / 2) / {(4 * math.pi) ** 2!r}{norm}, 4) + 0.0 as zeta_2, round(7 * sum(p.w1 * p.w2 * q.w2 * (5 * m * m * m - 3 * m) / 2) / {(4 * math.pi) ** 2!r}{norm}, 4) + 0.0 as zeta_3
from p join p q using (i) cross join lateral (select (p.dx * q.dx + p.dy * q.dy + p.dz * q.dz) / (p.s * q.s) as m) where p.b >= 0 and q.b >= 0 group by 1, 2"""


@query(triplet_sql(CUST, S3, True, TEDGES))
def threept_multipoles(spark, sf):
    t = paircount.triplet_poles(points(spark, sf, "customer"), TEDGES, (0, 2, 3), BOX, weight="w")
    return t.select("b1", "b2", *[r(f"zeta_{e}", 4).alias(f"zeta_{e}") for e in (0, 2, 3)])


# Mpc/h, in a survey of the near universe.
SEDGES = [2.0, 6.0, 10.0]


@query(triplet_sql(comoving_sql("customer"), S3, False, SEDGES))
def threept_survey(spark, sf):
    t = paircount.triplet_poles(_on_sky(spark, sf, "customer"), SEDGES, (0, 2, 3), weight="w", cosmo=_MATTER)
    return t.select("b1", "b2", *[r(f"zeta_{e}", 4).alias(f"zeta_{e}") for e in (0, 2, 3)])


# Groups

LINK = 3.0
_EDGES = f"select a.id as a, b.id as b from {CUST} a join {CUST} b on a.id <> b.id and " + " + ".join(f"power(a.{c} - b.{c} - {BOX} * round((a.{c} - b.{c}) / {BOX}, 0), 2)" for c in "xyz") + f" <= {LINK**2}"
FOF = f"""with recursive e as materialized ({_EDGES}), reach(id, m) as (select id, id from {CUST} union select e.b, reach.m from reach join e on e.a = reach.id and e.b > reach.m),
low as (select id, min(m) as m from reach group by id), sizes as (select m, count(*) as n, row_number() over (order by count(*) desc, m) as label from low group by m having count(*) > 2)
select id, cast(coalesce(label, 0) as bigint) as label from low left join sizes using (m)"""


def _fof(spark, sf) -> DataFrame:
    return groups.fof(points(spark, sf, "customer"), LINK, 2, BOX)


@query(FOF)
def fof_labels(spark, sf):
    return _fof(spark, sf)


@query(f"select label, cast(case when label = 0 then 0 else count(*) end as bigint) as length, round(avg(w), 6) as w from ({FOF}) join {CUST} using (id) group by label")
def fof_catalog(spark, sf):
    c = groups.fof_catalog(points(spark, sf, "customer"), _fof(spark, sf), BOX, ("w",))
    return c.select("label", F.col("length").cast("long").alias("length"), r("w").alias("w"))


@query(f"select label, count(*)::double * 1e12 as mass from ({FOF}) where label > 0 group by label")
def fof_halos(spark, sf):
    return groups.to_halos(groups.fof_catalog(points(spark, sf, "customer"), _fof(spark, sf), BOX), 1e12).select("label", "mass")


@query()
def cgm_groups(spark, sf):
    return groups.cylindrical_groups(points(spark, sf, "customer", F.col("c_acctbal")), "c_acctbal", 5.0, 8.0, BOX)


@query(f"""select id, round(1 / (power(r / {BOX}, 3) * {BOX**3}), 8) as density from (select a.id, sqrt({" + ".join(f"power(a.{c} - b.{c} - {BOX} * round((a.{c} - b.{c}) / {BOX}, 0), 2)" for c in "xyz")}) as r, row_number() over (partition by a.id order by r, b.id) as k from {CUST} a cross join {CUST} b) where k = 8""")
def knn_density(spark, sf):
    return groups.knn_density(points(spark, sf, "customer"), BOX).select("id", F.round("density", 8).alias("density"))


@query()
def fiber_collisions(spark, sf):
    src = points(spark, sf, "customer").select("id", (F.col("x") * 0.1).alias("ra"), (F.col("y") * 0.1 - 5).alias("dec"))
    return groups.fiber_collisions(src, 0.2)


@query("select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) - 1 as place from customer")
def dense_places(spark, sf):
    return dense_index(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], "place").drop("c_acctbal")


# Mocks and tables of bins


_TAIL = "(((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-u * u)"


@query(f"""select id, round(central, 6) + 0.0 as central, round(case when mass > power(10, 13.27) then central * power((mass - power(10, 13.27)) / power(10, 14.08), 0.76) else 0 end, 6) + 0.0 as satellite
from (select *, 0.5 * (1 + sign(u) * (1 - {_TAIL})) as central from (select *, 1 / (1 + 0.3275911 * abs(u)) as t from (select id, power(10, 12 + x / 25) as mass, (12 + x / 25 - 13.031) / 0.38 as u from {CUST})))""")
def hod_zheng_mean_occupation(spark, sf):
    cen, sat = mocks.zheng07_means(F.pow(F.lit(10.0), 12 + F.col("x") / 25))
    return points(spark, sf, "customer").select("id", r(cen).alias("central"), r(sat).alias("satellite"))


@query()
def uniform_mock(spark, sf):
    return mocks.uniform_catalog(spark, 1e-3, BOX)


@query()
def lognormal_mock(spark, sf):
    return mocks.lognormal_catalog(spark, Cosmology(), 0.5, 1e-3, BOX, N)


_TWO = pair_sql(CUST, CUST, "a.id <> b.id", S3, ", cast(least(floor(abs(dz) / s * 4), 3) as integer) as bin2", ", bin2")


def _two(spark, sf) -> histograms.Bins:
    p = paircount.box_pairs(points(spark, sf, "customer"), REDGES, BOX, mode="2d", n_mu=4, weight="w")
    return histograms.Bins(p.select("r_bin", "bin2", "npairs", "wnpairs"), {"r_bin": REDGES, "bin2": [0.0, 0.25, 0.5, 0.75, 1.0]})


@query(f"select r_bin, cast(floor(bin2 / 2) as integer) as bin2, cast(sum(npairs) as bigint) as npairs, sum(wnpairs) as wnpairs from ({_TWO}) group by 1, 2")
def binned_reindex(spark, sf):
    return _two(spark, sf).reindex("bin2", 2).df


@query(f"select r_bin, npairs, wnpairs from ({_TWO}) where bin2 = 1")
def binned_sel(spark, sf):
    return _two(spark, sf).sel("nearest", bin2=0.4).df


from skyloom.plans import box_queries, catalog_queries, stream_queries  # noqa: E402, F401  they register themselves
