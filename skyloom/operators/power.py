"""Power spectra and correlation functions of grids."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.sky import bin_of, legendre, real_ylm
from skyloom.operators import mesh as M
from skyloom.operators.box import Cells, Sides, ratios, three, volume
from skyloom.operators.numbering import dense_index, running_sum
from skyloom.plans.scratch import Scratch


def power_modes(a: DataFrame, b: DataFrame | None, size: float) -> DataFrame:
    """V * a * conj(b) on modes, V = size, 0 at the zero mode: (ix, iy, iz, re, im)."""
    if b is None:
        re, im, m = F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.lit(0.0), a
    else:
        m = a.join(b.select(*M.CELL, F.col("re").alias("re2"), F.col("im").alias("im2")), M.CELL)
        re, im = F.col("re") * F.col("re2") + F.col("im") * F.col("im2"), F.col("im") * F.col("re2") - F.col("re") * F.col("im2")
    zero = (F.col("ix") == 0) & (F.col("iy") == 0) & (F.col("iz") == 0)
    return m.select(*M.CELL, F.when(zero, 0.0).otherwise(re * size).alias("re"), F.when(zero, 0.0).otherwise(im * size).alias("im"))


def k_edges(n: Cells, box: Sides, dk: float | None = None, kmin: float = 0.0, kmax: float | None = None) -> list[float]:
    """Edges from kmin on, by default as wide as the shortest side's wavenumber, up to the lowest edge of the grid's wavenumbers."""
    dk = dk or 2 * math.pi / min(three(box))
    return np.arange(kmin, math.pi * min(three(n)) / max(three(box)) + dk / 2 if kmax is None else kmax, dk).tolist()


def squared_edges(edges: list[float], box: Sides) -> list[float]:
    """Edges in k as squares in units of the longest side's wavenumber, lowered by rounding's width."""
    return [(e * max(three(box)) / (2 * math.pi)) ** 2 * (1 - 1e-12) for e in edges]


def _mean(x: Column) -> Column:
    return F.sum(F.col("h") * x) / F.sum("h")


def bin_modes(p: DataFrame, n: Cells, box: Sides, edges: list[float], mu_edges: list[float] | None = None, poles: tuple[int, ...] = (), los=(0.0, 0.0, 1.0)) -> DataFrame:
    """Averages of modes by k (on k^2, bins [lo, hi)) and mu (last bin closed): k_bin, mu_bin, k, mu, power, modes, pole columns.

    A mode on an edge is in the bin above it: squared wavenumbers are compared with slightly lowered edges. Modes count with their Hermitian weight. Poles are averages over all mu, so they go with mu_edges=None.
    """
    m = M.with_wavenumbers(p, n, box, los)
    m = m.withColumn("k_bin", bin_of(F.col("n2"), squared_edges(edges, box))).where((F.col("k_bin") >= 0) & (F.col("k_bin") < len(edges) - 1))
    keys = ["k_bin"]
    if mu_edges is not None:
        at = F.least(bin_of(F.col("mu"), mu_edges), F.lit(len(mu_edges) - 2))
        m = m.withColumn("mu_bin", at).where("mu_bin >= 0")
        keys.append("mu_bin")
    cols = [_mean(F.col("k")).alias("k"), _mean(F.col("mu")).alias("mu"), _mean(F.col("re")).alias("power"), F.sum("h").cast("long").alias("modes")]
    for ell in poles:
        part = F.col("re") if ell % 2 == 0 else F.col("im")
        cols.append((_mean(part * legendre(ell, F.col("mu"))) * (2 * ell + 1)).alias(f"power_{ell}"))
    return m.groupBy(*keys).agg(*cols)


def unique_k(p: DataFrame, n: Cells, box: Sides, apart: float = 1e-5) -> DataFrame:
    """One bin for each distinct k, in rising order: bin, n2, k, power, modes.

    Wavenumbers that follow each other by less than `apart` of the smallest axis' unit are one. Modes are added up
    by their squared wavenumber first; only the distinct ones are sorted, by ranges.
    """
    m = M.with_wavenumbers(p, n, box)
    sums = m.groupBy("n2").agg(F.sum(F.col("h") * F.col("re")).alias("total"), F.sum("h").cast("long").alias("modes"))
    placed = dense_index(sums, ["n2"], "place")
    before = placed.select((F.col("place") + 1).alias("place"), F.col("n2").alias("lower"))
    gap = F.sqrt("n2") - F.sqrt("lower")
    # In units of the longest side's wavenumber, which is the smallest.
    starts = placed.join(before, "place", "left").withColumn("start", F.when(gap <= apart, 0).otherwise(1).cast("long"))
    found = running_sum(starts, ["place"], "start", "bin")
    out = found.groupBy((F.col("bin") - 1).alias("bin")).agg(F.min("n2").alias("n2"), F.sum("total").alias("total"), F.sum("modes").alias("modes"))
    return out.select("bin", "n2", (F.sqrt("n2") * (2 * math.pi / max(three(box)))).alias("k"), (F.col("total") / F.col("modes")).alias("power"), "modes")


def _transform_lines(grid: DataFrame, n: int, along: str, others: list[str], half: bool) -> DataFrame:
    """One axis of a transform: each line of n cells is a group of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros(n, complex)
        line[pdf[along]] = pdf["re"] + 1j * pdf["im"].to_numpy()
        c = (np.fft.fft(line) / n)[: n // 2 + 1 if half else n]
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in others}, along: np.arange(len(c)), "re": c.real, "im": c.imag})

    schema = ", ".join(f"{k} int" for k in (*others, along)) + ", re double, im double"
    return grid.groupBy(*others).applyInPandas(run, schema)


def projected_power(mesh: DataFrame, n: Cells, box: Sides, dk: float | None = None, kmin: float = 0.0, axes: str = "xy") -> DataFrame:
    """Power of the grid summed over the axes not named, transformed axis by axis in lines: k_bin, k, power, modes.

    The last axis named has half its modes, which count twice but for its first and (of an even grid) last. Modes on an edge are in the bin above.
    """
    cells, own = [f"i{a}" for a in axes], ["xyz".index(a) for a in axes]
    counts, sides = [three(n)[i] for i in own], [float(three(box)[i]) for i in own]
    dk = dk or 2 * math.pi / min(sides)
    edges = np.arange(kmin, math.pi * min(counts) / max(sides) + dk / 2, dk).tolist()
    m = M.preview(mesh, axes).select(*cells, F.col("v").alias("re"), F.lit(0.0).alias("im"))
    for c, cells_along in reversed(list(zip(cells, counts, strict=True))):
        m = _transform_lines(m, cells_along, c, [x for x in cells if x != c], c == cells[-1])
    signed = [F.when(F.col(c) > (k - 1) // 2, F.col(c) - k).otherwise(F.col(c)) * (max(sides) / side) for c, k, side in zip(cells, counts, sides, strict=True)]
    last = F.col(cells[-1])
    n2 = sum((x * x for x in signed), F.lit(0))
    m = m.withColumns({"n2": n2, "h": F.when((last == 0) | (last * 2 == counts[-1]), 1).otherwise(2)})
    power = F.when(F.col("n2") == 0, 0.0).otherwise((F.col("re") * F.col("re") + F.col("im") * F.col("im")) * math.prod(sides))
    m = m.withColumn("k_bin", bin_of(F.col("n2"), squared_edges(edges, (max(sides),) * 3))).where((F.col("k_bin") >= 0) & (F.col("k_bin") < len(edges) - 1))
    return m.groupBy("k_bin").agg(_mean(F.sqrt("n2") * (2 * math.pi / max(sides))).alias("k"), _mean(power).alias("power"), F.sum("h").cast("long").alias("modes"))


def correlation(p: DataFrame, n: Cells, box: Sides, edges: list[float], mu_edges: list[float] | None = None, poles: tuple[int, ...] = ()) -> DataFrame:
    """Correlation function: the inverse transform of the power over the volume, binned by separation and |mu|."""
    size = volume(box)
    scaled = p.select(*M.CELL, (F.col("re") / size).alias("re"), (F.col("im") / size).alias("im"))
    grid = M.ifft(scaled, n)
    cell = [side / c for side, c in zip(three(box), three(n), strict=True)]
    near = [F.when(F.col(c) > k // 2, F.col(c) - k).otherwise(F.col(c)) * (w / max(cell)) for c, k, w in zip(M.CELL, three(n), cell, strict=True)]
    r2 = sum((x * x for x in near), F.lit(0))
    m = grid.withColumns({"r2": r2, "z": near[2]}).withColumn("r", F.sqrt("r2") * max(cell))
    m = m.withColumns({"mu": F.when(F.col("r2") == 0, 0.0).otherwise(F.abs("z") / F.sqrt("r2")), "r_bin": bin_of(F.col("r"), edges)})
    m = m.where((F.col("r_bin") >= 0) & (F.col("r_bin") < len(edges) - 1))
    keys = ["r_bin"]
    if mu_edges is not None:
        m = m.withColumn("mu_bin", F.least(bin_of(F.col("mu"), mu_edges), F.lit(len(mu_edges) - 2)))
        keys.append("mu_bin")
    more = [(F.avg(F.col("v") * legendre(ell, F.col("mu"))) * (2 * ell + 1)).alias(f"corr_{ell}") for ell in poles]
    return m.groupBy(*keys).agg(F.avg("r").alias("r"), F.avg("v").alias("corr"), F.count("*").alias("modes"), *more)


@dataclass(frozen=True)
class Survey:
    """Data and randoms with the names of their columns: expected density, completeness weight and FKP weight."""

    data: DataFrame
    randoms: DataFrame
    density: str = "NZ"
    weight: str = "Weight"
    fkp: str = "FKPWeight"

    def crosses(self, other: Survey) -> bool:
        """Two fields may be correlated if they are of one catalog and differ in the FKP weight alone."""
        return self.data is other.data and self.randoms is other.randoms and (self.density, self.weight) == (other.density, other.weight)


def survey_sums(first: Survey, second: Survey | None = None) -> DataFrame:
    """One row: alpha, data_norm, randoms_norm (times alpha) and shotnoise, over the products of both FKP weights."""
    f, g = first.fkp, (second or first).fkp
    kinds = {"d": first.data, "r": first.randoms}
    rows = [t.select(F.lit(k).alias("kind"), F.col(first.weight).alias("w"), F.col(first.density).alias("n"), (F.col(f) * F.col(g)).alias("f")) for k, t in kinds.items()]
    what = {"w": F.col("w"), "norm": F.col("n") * F.col("w") * F.col("f"), "shot": F.col("w") * F.col("w") * F.col("f")}
    sums = rows[0].unionByName(rows[1]).agg(*[F.sum(F.when(F.col("kind") == k, c)).alias(f"{k}_{name}") for k in kinds for name, c in what.items()])
    alpha = F.col("d_w") / F.col("r_w")
    norm = alpha * F.col("r_norm")
    return sums.select(alpha.alias("alpha"), F.col("d_norm").alias("data_norm"), norm.alias("randoms_norm"), ((F.col("d_shot") + alpha * alpha * F.col("r_shot")) / norm).alias("shotnoise"))


def fkp_sums(first: Survey, second: Survey | None = None) -> dict:
    """The sums as numbers; data and randoms must agree on the normalisation."""
    s = survey_sums(first, second).first().asDict()
    if abs(s["randoms_norm"] / s["data_norm"] - 1) > 0.05:
        raise ValueError("data and randoms disagree on the normalisation by more than 5 %")
    return s


def fkp_field(first: Survey, alpha: float, n: Cells, box: Sides, window: str = "cic", second: Survey | None = None) -> DataFrame:
    """Data less alpha times randoms over the cell volume, both weighted by completeness and FKP weight; positions in [0, box).

    Columns v (and v2 of the second field, painted in the same pass).
    """
    fields = {"v": first.fkp} | ({"v2": second.fkp} if second else {})
    sides = [t.select("x", "y", "z", *[(F.col(first.weight) * F.col(c) * sign).alias(v) for v, c in fields.items()]) for t, sign in ((first.data, 1.0), (first.randoms, -alpha))]
    at = M.spread(sides[0].unionByName(sides[1]), n, box, window, [F.col(v) for v in fields])
    scale = volume(n) / volume(box)
    return at.groupBy(*M.CELL).agg(*[(F.sum(F.col("w") * F.col(v)) * scale).alias(v) for v in fields])


def survey_poles(first: Survey, n: Cells, box: Sides, centre: tuple[float, float, float], edges: list[float], poles: tuple[int, ...] = (0, 2), window: str = "cic", compensated: bool = False, second: Survey | None = None) -> DataFrame:
    """Multipoles of a survey by weighted transforms: A_l = 4 pi V sum_m Y_lm(k) FFT[Y_lm(x) F]; P_l = A_0 conj(A_l) / norm.

    The cells' directions are seen from the origin, with the box's centre at `centre`. With a second field of the
    same catalog, A_0 is of the first and A_l of the second. All weighted fields go through one transform, and
    compensated modes are divided by the window's power. The mode k = 0 counts as it is.
    """
    if second is not None and not first.crosses(second):
        raise ValueError("the second field must be of the same catalog, with another FKP weight alone")
    sums, size, other = fkp_sums(first, second), volume(box), "v2" if second else "v"
    field = fkp_field(first, sums["alpha"], n, box, window, second)
    where = [(F.col(c) + 0.5) * (side / cells) + (o - side / 2) for c, o, side, cells in zip(M.CELL, centre, three(box), three(n), strict=True)]
    r = F.sqrt(sum((x * x for x in where), F.lit(0.0)))
    seen = field.withColumns({f"u{a}": F.when(r == 0, 0.0).otherwise(w / r) for a, w in zip("xyz", where, strict=True)})
    names = {(e, m): f"y{e}_{m + e}" for e in poles if e for m in range(-e, e + 1)}
    grids = {"v": F.col("v")} | ({"v2": F.col("v2")} if second else {}) | {v: F.col(other) * real_ylm(e, m, F.col("ux"), F.col("uy"), F.col("uz")) for (e, m), v in names.items()}
    # A single grid would be named re and im.
    grids = grids if len(grids) > 1 else {"v": F.col("v"), "v2": F.col("v")}
    out = M.with_wavenumbers(M.fft(seen.select(*M.CELL, *[c.alias(v) for v, c in grids.items()]), n, list(grids)), n, box)
    kn = F.when(F.col("n2") == 0, 1.0).otherwise(F.sqrt("n2"))
    window_power = M.window_power(n, window) if compensated else F.lit(1.0)

    def second_part(ell: int) -> tuple[Column, Column]:
        if ell == 0:
            return F.col(f"re_{other}") * size, F.col(f"im_{other}") * size
        y = {m: real_ylm(ell, m, F.col("qx") / kn, F.col("qy") / kn, F.col("qz") / kn) for m in range(-ell, ell + 1)}
        return tuple(sum((y[m] * F.col(f"{part}_{names[ell, m]}") for m in y), F.lit(0.0)) * (4 * math.pi * size) for part in ("re", "im"))

    cols = []
    for e in poles:
        re, im = second_part(e)
        cols.append(((F.col("re_v") * re + F.col("im_v") * im) * (size / sums["randoms_norm"]) / window_power).alias(f"p{e}"))
    m = out.select("n2", "k", "h", *cols).withColumn("k_bin", bin_of(F.col("n2"), squared_edges(edges, box)))
    m = m.where((F.col("k_bin") >= 0) & (F.col("k_bin") < len(edges) - 1))
    return m.groupBy("k_bin").agg(_mean(F.col("k")).alias("k"), F.sum("h").cast("long").alias("modes"), *[_mean(F.col(f"p{e}")).alias(f"power_{e}") for e in poles])


def poles_to_wedges(poles: DataFrame, mu_edges: list[float], ells: tuple[int, ...]) -> DataFrame:
    """P(k, mu wedge) from even multipoles, with the mean of each Legendre polynomial over the wedge."""
    wedges = []
    for i, (a, b) in enumerate(zip(mu_edges[:-1], mu_edges[1:], strict=True)):
        p = F.lit(0.0)
        for e in ells:
            c = np.polynomial.legendre.legint([0] * e + [1])
            p = p + F.col(f"power_{e}") * float((np.polynomial.legendre.legval(b, c) - np.polynomial.legendre.legval(a, c)) / (b - a))
        wedges.append(F.struct(F.lit(i).alias("mu_bin"), p.alias("power")))
    return poles.select("k_bin", "k", F.explode(F.array(*wedges)).alias("w")).select("k_bin", "k", "w.mu_bin", "w.power")


def displacement(modes: DataFrame, n: Cells, box: Sides, radius: float, bias: float, f: float = 0.0) -> DataFrame:
    """The reconstruction displacement's modes: i k / k^2 * delta * exp(-k^2 R^2 / 2) / (b (1 + f / b mu^2)), in re_sx, im_sx and so on."""
    m = M.with_wavenumbers(modes, n, box)
    k0 = 2 * math.pi / max(three(box))
    damped = F.exp(-F.col("n2") * (k0 * k0 * radius * radius / 2)) / (bias * (1 + f / bias * F.col("mu") * F.col("mu")))
    g = {a: F.when(F.col("n2") == 0, 0.0).otherwise(F.col(f"q{a}") / (F.col("n2") * k0) * damped) for a in "xyz"}
    return m.select(*M.CELL, *[c for a in "xyz" for c in ((-F.col("im") * g[a]).alias(f"re_s{a}"), (F.col("re") * g[a]).alias(f"im_s{a}"))])


def reconstruct(data: DataFrame, randoms: DataFrame, n: Cells, box: Sides, radius: float, bias: float, f: float = 0.0, scheme: str = "LGS", revert_rsd_random: bool = False, window: str = "cic") -> DataFrame:
    """Reconstructed density contrast on the grid, lines of sight along z, by schemes

    LGS, the moved data less the moved randoms, LRR, the data less half the sum of the randoms moved to and fro,
    or LF2 = 3/7 LGS + 4/7 LRR. The three displacements go through one transform and one reading of the grid.
    """
    if scheme not in ("LGS", "LRR", "LF2"):
        raise ValueError(f"unknown scheme {scheme}")
    scratch, axes = Scratch(data.sparkSession), ("sx", "sy", "sz")
    totals = {"data": data.count(), "randoms": randoms.count()}
    modes = M.fft(M.density(M.paint(data, n, box, window), n, totals["data"]), n)
    grid = scratch.keep(M.ifft(displacement(modes, n, box, radius, bias, f), n, axes), "displacement")
    along = {"data": 1 + f, "randoms": 1 + f if revert_rsd_random else 1.0}
    seen = {k: scratch.keep(df.select("id", "x", "y", "z").join(M.readout(df, grid, n, box, window, axes), "id"), k) for k, df in (("data", data), ("randoms", randoms))}

    # (catalog, sign of the displacement, weight in the result); all fields are one painting.
    lgs = [("data", 1, 1.0), ("randoms", 1, -1.0)]
    lrr = [("data", 0, 1.0), ("randoms", -1, -0.5), ("randoms", 1, -0.5)]
    terms = {"LGS": lgs, "LRR": lrr, "LF2": [(c, s, w * 3 / 7) for c, s, w in lgs] + [(c, s, w * 4 / 7) for c, s, w in lrr]}[scheme]
    moved = None
    for name, sign, weight in terms:
        step = {a: F.col(f"s{a}") * (sign * (along[name] if a == "z" else 1.0)) for a in "xyz"}
        part = seen[name].select(*[F.pmod(F.col(a) - step[a], F.lit(float(side))).alias(a) for a, side in zip("xyz", three(box), strict=True)], F.lit(weight * volume(n) / totals[name]).alias("m"))
        moved = part if moved is None else moved.unionByName(part)
    found = M.paint(moved, n, box, window, F.col("m"))
    return M.all_cells(data.sparkSession, n).join(found, M.CELL, "left").select(*M.CELL, F.coalesce("v", F.lit(0.0)).alias("v"))
