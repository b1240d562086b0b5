"""Queries in boxes and grids with unequal sides, of surveys and of reconstructed fields, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import sky
from skyloom.operators import mesh as M
from skyloom.operators import paircount, power, volumes
from skyloom.operators.box import volume
from skyloom.operators.field import Mesh
from skyloom.plans.queries import BOX, CIC_MODES, CUST, EDGES, MU, N, REDGES, S3, auto_sql, bins_sql, pair_sql, paint_sql, points, points_sql, query, r

SIDES, CELLS = (100.0, 80.0, 50.0), (8, 6, 4)
_SCALE = dict(zip("xyz", (1.0, 0.8, 0.5), strict=True))
_EDGES = power.k_edges(CELLS, SIDES)
_UNIT = 2 * math.pi / 100.0


def in_box(spark, sf, name: str) -> DataFrame:
    return points(spark, sf, name).withColumns({a: F.col(a) * f for a, f in _SCALE.items()})


def in_box_sql(name: str) -> str:
    return "(select id, w, " + ", ".join(f"{a} * {f!r} as {a}" for a, f in _SCALE.items()) + f" from {points_sql(name)})"


def cells_sql(src: str, mass: str = "1.0::double") -> str:
    """Cells of the unequal grid, painted by cic."""
    at = ", ".join(f"{a} * {c / side!r} as s{a}" for a, c, side in zip("xyz", CELLS, SIDES, strict=True))
    near = ", ".join(f"(cast(floor(s{a}) as bigint) + o{a}.o) as j{a}" for a in "xyz")
    weight = " * ".join(f"(1 - abs(s{a} - j{a}))" for a in "xyz")
    place = ", ".join(f"cast(((j{a} % {c}) + {c}) % {c} as integer) as i{a}" for a, c in zip("xyz", CELLS, strict=True))
    steps = " ".join(f"cross join (select unnest(range(0, 2)) as o) o{a}" for a in "xyz")
    return f"select {place}, sum({weight} * m) as v from (select *, {near} from (select {at}, {mass} as m from {src}) p {steps}) q group by 1, 2, 3"


def phase(a: str = "m", b: str = "i", cells: tuple[int, ...] = CELLS) -> str:
    return "(" + " + ".join(f"{2 * math.pi / c!r} * {a}{x} * {b}{x}" for x, c in zip("xyz", cells, strict=True)) + ")"


def range_sql(name: str, n: int) -> str:
    return f"(select cast(unnest(range(0, {n})) as integer) as {name}) {name}s"


def transform_sql(cells: str, n: tuple[int, ...] = CELLS) -> str:
    """Modes by the direct transform of cells."""
    signed = ", ".join(f"case when m{a} > {(c - 1) // 2} then m{a} - {c} else m{a} end as n{a}" if a != "z" else "mz as nz" for a, c in zip("xyz", n, strict=True))
    return f"""select mx as ix, my as iy, mz as iz, {signed}, case when mz > 0 and mz * 2 < {n[2]} then 2 else 1 end as h, sum(v * cos{phase(cells=n)}) / {math.prod(n)} as re, -sum(v * sin{phase(cells=n)}) / {math.prod(n)} as im
from ({cells}) c cross join {range_sql("mx", n[0])} cross join {range_sql("my", n[1])} cross join {range_sql("mz", n[2] // 2 + 1)} group by mx, my, mz"""


_MODES = transform_sql(f"select ix, iy, iz, v * {math.prod(CELLS)} / (select count(*) from orders) as v from ({cells_sql(in_box_sql('orders'))})")
_Q2 = "(nx * nx + ny * 1.25 * (ny * 1.25) + nz * 2.0 * (nz * 2.0))"
_AUTO = f"select *, sqrt(q2) * {_UNIT!r} as k, case when q2 = 0 then 0 else nz * 2.0 / sqrt(q2) end as mu from (select *, cast({_Q2} as double) as q2, case when {_Q2} = 0 then 0 else (re * re + im * im) * {volume(SIDES)!r} end as p from ({_MODES}))"
_BINNED = f"select *, {' + '.join(f'cast(q2 >= {e:.17e} as integer)' for e in power.squared_edges(_EDGES, SIDES))} - 1 as k_bin from ({_AUTO})"


def _mean(what: str, name: str, digits: int = 4) -> str:
    return f"round(sum(h * {what}) / sum(h), {digits}) + 0.0 as {name}"


def _binned(more: str = "", keys: str = "k_bin", src: str = _BINNED) -> str:
    return f"select {keys}, {_mean('k', 'k', 6)}, {_mean('p', 'power')}, cast(sum(h) as bigint) as modes{more} from ({src}) where k_bin between 0 and {len(_EDGES) - 2} group by {keys}"


def _modes(spark, sf) -> DataFrame:
    src = in_box(spark, sf, "orders")
    return M.fft(M.density(M.paint(src, CELLS, SIDES), CELLS, src.count()), CELLS)


def _power(spark, sf, **more) -> DataFrame:
    p = power.bin_modes(power.power_modes(_modes(spark, sf), None, volume(SIDES)), CELLS, SIDES, _EDGES, **more)
    return p.select(*[c for c in ("k_bin", "mu_bin") if c in p.columns], r("k").alias("k"), r("power", 4).alias("power"), "modes", *[r(c, 4).alias(c) for c in p.columns if c.startswith("power_")])


@query(_binned(f", {_mean('p', 'power_0')}, round(5 * sum(h * p * (3 * mu * mu - 1) / 2) / sum(h), 4) + 0.0 as power_2"))
def power_unequal_box(spark, sf):
    return _power(spark, sf, poles=(0, 2))


@query(_binned("", "k_bin, mu_bin", f"select *, least({' + '.join(f'cast(mu >= {e} as integer)' for e in MU)} - 1, {len(MU) - 2}) as mu_bin from ({_BINNED})"))
def power_2d_unequal_box(spark, sf):
    return _power(spark, sf, mu_edges=MU)


@query(f"select row_number() over (order by q2) - 1 as bin, round(sqrt(q2) * {_UNIT!r}, 6) as k, {_mean('p', 'power')}, cast(sum(h) as bigint) as modes from ({_AUTO}) group by q2")
def power_unique_k_unequal_box(spark, sf):
    found = power.unique_k(power.power_modes(_modes(spark, sf), None, volume(SIDES)), CELLS, SIDES)
    return found.select("bin", r("k").alias("k"), r("power", 4).alias("power"), "modes")


_RADII = [1.0, 15.0, 30.0]
_GAP = ", ".join(f"(case when c{a} > {c // 2} then c{a} - {c} else c{a} end) * {side / c!r} as d{a}" for a, c, side in zip("xyz", CELLS, SIDES, strict=True))


@query(f"""select {" + ".join(f"cast(s >= {e} as integer)" for e in _RADII)} - 1 as r_bin, round(avg(s), 6) as r, round(avg(v), 8) + 0.0 as corr, count(*) as modes from (select *, sqrt(dx * dx + dy * dy + dz * dz) as s from (select {_GAP}, v from (
  select cx, cy, cz, sum(h * p * cos{phase("i", "c")}) / {volume(SIDES)!r} as v from ({_AUTO}) cross join {range_sql("cx", CELLS[0])} cross join {range_sql("cy", CELLS[1])} cross join {range_sql("cz", CELLS[2])} group by cx, cy, cz)))
where s >= {_RADII[0]} and s < {_RADII[-1]} group by 1""")
def fft_corr_unequal_box(spark, sf):
    c = power.correlation(power.power_modes(_modes(spark, sf), None, volume(SIDES)), CELLS, SIDES, _RADII)
    return c.select("r_bin", r("r").alias("r"), r("corr", 8).alias("corr"), "modes")


_PLANE = f"""select case when mx > 3 then mx - 8 else mx end as nx, mz as nz, case when mz > 0 and mz < 2 then 2 else 1 end as h, sum(v * cos({math.pi / 4!r} * mx * ix + {math.pi / 2!r} * mz * iz)) / 32 as re, sum(v * sin({math.pi / 4!r} * mx * ix + {math.pi / 2!r} * mz * iz)) / 32 as im
from ({cells_sql(in_box_sql('orders'))}) c cross join {range_sql("mx", 8)} cross join {range_sql("mz", 3)} group by mx, mz"""
_FLAT_EDGES = [i * 2 * math.pi / 50 for i in range(3)]


@query(f"""select {" + ".join(f"cast(q2 >= {e:.17e} as integer)" for e in power.squared_edges(_FLAT_EDGES, (100.0,) * 3))} - 1 as k_bin, round(sum(h * sqrt(q2)) * {_UNIT!r} / sum(h), 6) as k, round(sum(h * case when q2 = 0 then 0 else (re * re + im * im) * 5000 end) / sum(h), 4) + 0.0 as power, cast(sum(h) as bigint) as modes
from (select *, nx * nx + nz * 2 * nz * 2 as q2 from ({_PLANE})) where q2 < {power.squared_edges(_FLAT_EDGES, (100.0,) * 3)[int(math.pi * 4 / 100 / (2 * math.pi / 50) + 0.5)]!r} group by 1""")
def power_projected_unequal_box(spark, sf):
    p = power.projected_power(M.paint(in_box(spark, sf, "orders"), CELLS, SIDES), CELLS, SIDES, axes="xz")
    return p.select("k_bin", r("k").alias("k"), r("power", 4).alias("power"), "modes")


_BOX_GAP = {a: f"a.{a} - b.{a} - {s!r} * round((a.{a} - b.{a}) / {s!r}, 0)" for a, s in zip("xyz", SIDES, strict=True)}


def _unequal_pairs(a: str, b: str, where: str) -> str:
    found = pair_sql(a, b, where, S3, ", cast(least(floor(abs(dy) / s * 4), 3) as integer) as bin2", ", bin2")
    for x, gap in _BOX_GAP.items():
        found = found.replace(f"a.{x} - b.{x} - {BOX} * round((a.{x} - b.{x}) / {BOX}, 0)", gap)
    return found


@query(_unequal_pairs(in_box_sql("customer"), in_box_sql("customer"), "a.id <> b.id"))
def pairs_unequal_box(spark, sf):
    return paircount.box_pairs(in_box(spark, sf, "customer"), REDGES, SIDES, mode="2d", los="y", n_mu=4, weight="w").withColumn("r", F.round("r", 6))


@query(_unequal_pairs(in_box_sql("customer"), in_box_sql("supplier"), "true"))
def pairs_cross_unequal_box(spark, sf):
    return paircount.box_pairs(in_box(spark, sf, "customer"), REDGES, SIDES, in_box(spark, sf, "supplier"), mode="2d", los="y", n_mu=4, weight="w").withColumn("r", F.round("r", 6))


# Another number of cells: the same waves read on other cells


def _read_sql(waves: str, to: tuple[int, ...], n: tuple[int, ...]) -> str:
    """Cells of a grid `to` from waves (nx, ny, nz, h, re, im); an even grid's edge wave is the mean of both its signs."""
    factor = {a: (f"cos({2 * math.pi / t!r} * n{a} * c{a})", f"case when {int(t > c)} = 1 and abs(n{a}) * 2 = {c} then 0 else sin({2 * math.pi / t!r} * n{a} * c{a}) end") for a, t, c in zip("xyz", to, n, strict=True)}
    parts = ", ".join(f"{c} as c_{a}, {s} as s_{a}" for a, (c, s) in factor.items())
    re = "(c_x * c_y * c_z - c_x * s_y * s_z - s_x * c_y * s_z - s_x * s_y * c_z)"
    im = "(s_x * c_y * c_z + c_x * s_y * c_z + c_x * c_y * s_z - s_x * s_y * s_z)"
    return f"""select cx as ix, cy as iy, cz as iz, round(sum(h * (re * {re} - im * {im})), 8) + 0.0 as v from (select cx, cy, cz, h, re, im, {parts} from ({waves}) m cross join {range_sql("cx", to[0])} cross join {range_sql("cy", to[1])} cross join {range_sql("cz", to[2])}) group by 1, 2, 3"""


def _resampled(spark, sf, to: tuple[int, ...]) -> DataFrame:
    mesh = Mesh.from_points(in_box(spark, sf, "orders"), CELLS, SIDES)
    return mesh.compute("real", to).withColumn("v", r("v", 8))


@query(_read_sql(f"select * from ({_MODES}) where abs(nx) <= 2 and abs(ny) <= 1 and nz <= 1", (4, 3, 2), CELLS))
def mesh_resample_crop(spark, sf):
    return _resampled(spark, sf, (4, 3, 2))


@query(_read_sql(_MODES, (12, 6, 6), CELLS))
def mesh_resample_pad(spark, sf):
    return _resampled(spark, sf, (12, 6, 6))


# Surveys

_CENTRE = (0.0, 0.0, 300.0)


def survey(spark, sf, second: str = "FKPWeight") -> power.Survey:
    sides = [points(spark, sf, name).select("id", "x", "y", "z", F.lit(1e-3).alias("NZ"), F.col("w").alias("Weight"), sky.fkp_weight(F.lit(1e-3), 1e4).alias("FKPWeight"), (1 / (1 + F.col("w"))).alias("Other")) for name in ("customer", "orders")]
    return power.Survey(*sides)


def _survey_sql(second: str) -> str:
    """Multipoles 0 and 2 by direct sums over cells and modes, with the Legendre polynomial of the angle between them."""
    one = repr(1 / 11)
    other = one if second == "FKPWeight" else "(1 / (1 + w))"
    norm = f"(select (select sum(w) from {CUST}) / sum(w) * sum(1e-3 * w * {one} * {other}) as norm from {points_sql('orders')})"
    alpha = f"((select sum(w) from {CUST}) / (select sum(w) from {points_sql('orders')}))"
    both = f"(select x, y, z, w, 1.0 as sign from {CUST} union all select x, y, z, w, -{alpha} as sign from {points_sql('orders')})"
    field = {k: paint_sql(both, "cic", f"w * sign * {v}") for k, v in (("f", one), ("g", other))}
    at = ", ".join(f"(i{a} + 0.5) * {BOX / N!r} + {o - BOX / 2!r} as u{a}" for a, o in zip("xyz", _CENTRE, strict=True))
    scale = (N / BOX) ** 3
    cells = f"select ix, iy, iz, f.v * {scale!r} as f, g.v * {scale!r} as g, {at} from ({field['f']}) f join ({field['g']}) g using (ix, iy, iz)"
    signed = ", ".join(f"case when m{a} > {N // 2 - 1} then m{a} - {N} else m{a} end as n{a}" if a != "z" else "mz as nz" for a in "xyz")
    legendre = "(case when nx = 0 and ny = 0 and nz = 0 then 0 else (3 * mu * mu - 1) / 2 end)"
    angle = "(ux * nx + uy * ny + uz * nz) / sqrt((ux * ux + uy * uy + uz * uz) * (nx * nx + ny * ny + nz * nz))"
    pairs = f"select *, {phase(cells=(N,) * 3)} as t, case when nx = 0 and ny = 0 and nz = 0 then 0 else {angle} end as mu from (select *, {signed} from ({cells}) c cross join {range_sql('mx', N)} cross join {range_sql('my', N)} cross join {range_sql('mz', N // 2 + 1)})"
    sums = ", ".join(f"sum({what} * cos(t)) * {BOX**3 / N**3!r} as {name}_re, -sum({what} * sin(t)) * {BOX**3 / N**3!r} as {name}_im" for name, what in (("f", "f"), ("g", "g"), ("l", f"5 * g * {legendre}")))
    modes = f"select nx, ny, nz, case when nz > 0 and nz < {N // 2} then 2 else 1 end as h, {sums} from ({pairs}) group by nx, ny, nz"
    window = " * ".join(f"(1 - 2.0 / 3 * power(sin({math.pi / N!r} * n{a}), 2))" for a in "xyz")
    edge = " + ".join(f"cast(n2 >= {e:.17e} as integer)" for e in power.squared_edges(EDGES, BOX))
    powers = ", ".join(f"(f_re * {c}_re + f_im * {c}_im) / norm / ({window}) as {name}" for name, c in (("p0", "g"), ("p2", "l")))
    return f"""select {edge} - 1 as k_bin, round(sum(h * sqrt(n2)) * {2 * math.pi / BOX!r} / sum(h), 6) as k, cast(sum(h) as bigint) as modes, round(sum(h * p0) / sum(h), 4) + 0.0 as power_0, round(sum(h * p2) / sum(h), 4) + 0.0 as power_2
from (select nx * nx + ny * ny + nz * nz as n2, h, {powers} from ({modes}), {norm}) where {edge} between 1 and {len(EDGES) - 1} group by 1"""


def _poles(spark, sf, second: bool) -> DataFrame:
    one = survey(spark, sf)
    other = power.Survey(one.data, one.randoms, fkp="Other") if second else None
    p = power.survey_poles(one, N, BOX, _CENTRE, EDGES, (0, 2), compensated=True, second=other)
    return p.select("k_bin", r("k").alias("k"), "modes", r("power_0", 4).alias("power_0"), r("power_2", 4).alias("power_2"))


@query(_survey_sql("FKPWeight"))
def convpower_poles(spark, sf):
    return _poles(spark, sf, False)


@query(_survey_sql("Other"))
def convpower_poles_two_weights(spark, sf):
    return _poles(spark, sf, True)


# Reconstruction

_RADIUS, _BIAS, _F = 20.0, 2.0, 0.5
_K0 = 2 * math.pi / BOX


def _reconstruction_sql(terms: list[tuple[str, int, float]], back: bool) -> str:
    """The displacement by direct sums over modes, read at every object, and all moved objects painted."""
    n2 = "(nx * nx + ny * ny + nz * nz)"
    g = f"(case when {n2} = 0 then 0 else exp(-{n2} * {_K0**2 * _RADIUS**2 / 2!r}) / ({_BIAS} * (1 + {_F / _BIAS} * nz * nz / {n2})) / ({n2} * {_K0!r}) end)"
    # The transform used elsewhere takes the edge waves as positive; here they are negative.
    waves = f"select ix, iy, iz, h, re, im, case when nx = {N // 2} then -nx else nx end as nx, case when ny = {N // 2} then -ny else ny end as ny, nz from ({CIC_MODES})"
    t = phase("i", "c", (N,) * 3)
    sums = ", ".join(f"sum(h * n{a} * {g} * (-im * cos{t} - re * sin{t})) as s{a}" for a in "xyz")
    steps = f"select cx, cy, cz, {sums} from ({waves}) cross join {range_sql('cx', N)} cross join {range_sql('cy', N)} cross join {range_sql('cz', N)} group by cx, cy, cz"
    near = ", ".join(f"cast((cast(floor(q{a}) as bigint) + o{a}.o) % {N} as integer) as c{a}" for a in "xyz")
    weight = " * ".join(f"(1 - abs(q{a} - floor(q{a}) - o{a}.o))" for a in "xyz")
    offsets = " ".join(f"cross join (select unnest(range(0, 2)) as o) o{a}" for a in "xyz")
    ctes = [f"steps as materialized ({steps})"]
    for name in ("orders", "customer"):
        src = f"(select *, {', '.join(f'{a} * {N / BOX!r} as q{a}' for a in 'xyz')} from {points_sql(name)})"
        ctes.append(f"{name}_at as materialized (select id, x, y, z, sum(wt * sx) as sx, sum(wt * sy) as sy, sum(wt * sz) as sz from (select p.*, {near}, {weight} as wt from {src} p {offsets}) join steps using (cx, cy, cz) group by id, x, y, z)")
    parts = []
    for name, sign, w in terms:
        along = 1 + _F if name == "orders" or back else 1.0
        cols = ", ".join(f"(({a} - {sign * (along if a == 'z' else 1.0)!r} * s{a}) % {BOX} + {BOX}) % {BOX} as {a}" for a in "xyz")
        parts.append(f"select {cols}, {w * N**3!r}::double / (select count(*) from {name}) as m from {name}_at")
    painted = paint_sql("(" + " union all ".join(parts) + ")", "cic", "m")
    return f"with {', '.join(ctes)} select ix, iy, iz, round(sum(v), 6) + 0.0 as v from ({painted} union all select ix, iy, iz, 0.0 from (select cx as ix, cy as iy, cz as iz from steps)) group by ix, iy, iz"


_LGS = [("orders", 1, 1.0), ("customer", 1, -1.0)]
_LRR = [("orders", 0, 1.0), ("customer", -1, -0.5), ("customer", 1, -0.5)]
_LF2 = [(c, s, w * 3 / 7) for c, s, w in _LGS] + [(c, s, w * 4 / 7) for c, s, w in _LRR]


def _reconstructed(name: str, scheme: str, terms: list, back: bool):
    def run(spark, sf):
        found = power.reconstruct(points(spark, sf, "orders"), points(spark, sf, "customer"), N, BOX, _RADIUS, _BIAS, _F, scheme, back)
        return found.withColumn("v", r("v"))

    run.__name__ = name
    return query(_reconstruction_sql(terms, back))(run)


_reconstructed("recon_lgs", "LGS", _LGS, True)
_reconstructed("recon_lrr", "LRR", _LRR, False)
_reconstructed("reconstruction", "LF2", _LF2, False)


# Sub-volumes

_MOST, _MARGIN, _DEPTH = 24, 3.0, 4


def _volumes_sql() -> str:
    """The octree from counts at all of its levels, and every image of every point against every box."""
    src = in_box_sql("customer")
    cell = lambda a, k: f"least(cast(floor({a} * {2**k / dict(zip('xyz', SIDES, strict=True))[a]!r}) as bigint), {2**k - 1})"
    nodes = " union all ".join(f"select {k} as level, {', '.join(f'{cell(a, k)} as c{a}' for a in 'xyz')}, count(*) as n from {src} group by all" for k in range(_DEPTH + 1))
    # A box is one of the tree if it is not cut itself, and its parent is.
    parent = f"exists (select 1 from nodes p where p.level = n.level - 1 and p.cx = n.cx // 2 and p.cy = n.cy // 2 and p.cz = n.cz // 2 and p.n > {_MOST})"
    corners = ", ".join(f"c{a} * {s!r} / (1 << level) as lo_{a}, (c{a} + 1) * {s!r} / (1 << level) as hi_{a}" for a, s in zip("xyz", SIDES, strict=True))
    images = " ".join(f"cross join (values (-{s!r}), (0.0), ({s!r})) i{a}(d{a})" for a, s in zip("xyz", SIDES, strict=True))
    near = " and ".join(f"{a} + d{a} + {_MARGIN} >= lo_{a} and {a} + d{a} - {_MARGIN} < hi_{a}" for a in "xyz")
    inside = " and ".join(f"d{a} = 0 and {a} >= lo_{a} and {a} < hi_{a}" for a in "xyz")
    return f"""with nodes as materialized ({nodes}), boxes as materialized (select {corners} from nodes n where (n <= {_MOST} or level = {_DEPTH}) and (level = 0 or {parent}))
select id, not ({inside}) as ghost, {", ".join(f"round({a} + d{a}, 6) + 0.0 as {a}, round(lo_{a}, 6) as lo_{a}, round(hi_{a}, 6) as hi_{a}" for a in "xyz")} from {src} {images} join boxes on {near}"""


@query(_volumes_sql())
def sub_volumes(spark, sf):
    src = in_box(spark, sf, "customer")
    found = volumes.sub_volumes(src, SIDES, _MOST, _MARGIN)
    return found.select("id", "ghost", *[c for i, a in enumerate("xyz") for c in (r(a).alias(a), F.round(F.col("lo")[i], 6).alias(f"lo_{a}"), F.round(F.col("hi")[i], 6).alias(f"hi_{a}"))])


# Wedges of mu from multipoles

_WEDGES = [0.0, 0.25, 0.5, 1.0]


def _mean_legendre(ell: int, a: float, b: float) -> float:
    whole = {0: lambda x: x, 2: lambda x: (x**3 - x) / 2, 4: lambda x: (7 * x**5 - 10 * x**3 + 3 * x) / 8}[ell]
    return (whole(b) - whole(a)) / (b - a)


_POLE_SUMS = f"select k_bin, sum(h * sqrt(n2)) * {_K0!r} / sum(h) as k, sum(h * re) / sum(h) as p0, 5 * sum(h * re * (3 * mu * mu - 1) / 2) / sum(h) as p2, 9 * sum(h * re * (35 * mu * mu * mu * mu - 30 * mu * mu + 3) / 8) / sum(h) as p4 from ({bins_sql(auto_sql(CIC_MODES))}) where k_bin between 0 and {len(EDGES) - 2} group by k_bin"


@query(" union all ".join(f"select k_bin, {i} as mu_bin, round(k, 6) as k, round({' + '.join(f'p{e} * {_mean_legendre(e, a, b)!r}' for e in (0, 2, 4))}, 4) + 0.0 as power from ({_POLE_SUMS})" for i, (a, b) in enumerate(zip(_WEDGES[:-1], _WEDGES[1:], strict=True))))
def power_wedges(spark, sf):
    src = points(spark, sf, "orders")
    modes = M.fft(M.density(M.paint(src, N, BOX), N, src.count()), N)
    poles = power.bin_modes(power.power_modes(modes, None, BOX**3), N, BOX, EDGES, poles=(0, 2, 4))
    return power.poles_to_wedges(poles, _WEDGES, (0, 2, 4)).select("k_bin", "mu_bin", r("k").alias("k"), r("power", 4).alias("power"))
