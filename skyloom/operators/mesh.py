"""Regular grids as tables: painting, reading out, Fourier transforms and filters.

A real grid is a table (ix, iy, iz, v), cells that are absent are 0. A complex grid is a table of the
half space (ix, iy, iz, re, im) with 0 <= iz <= Nz / 2. The forward transform divides by the number of
cells, the inverse does not. Numbers of cells `n` and sides `box` are one number or one for each axis.

A table may hold several grids: real ones in columns of any names, their transforms in re_NAME and
im_NAME. All of them go through one pair of shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.box import Cells, Sides, ratios, three, volume

CELL = ["ix", "iy", "iz"]
#: Order of the B-spline of each window.
ORDERS = {"ngp": 1, "cic": 2, "tsc": 3, "pcs": 4}


def window_sql(order: int, d: str) -> str:
    """B-spline weight at a distance d >= 0 in cells, as SQL that Spark and others evaluate alike."""
    return {
        1: "1.0D",
        2: f"(1 - {d})",
        3: f"(case when {d} < 0.5 then 0.75 - {d} * {d} else 0.5 * (1.5 - {d}) * (1.5 - {d}) end)",
        4: f"(case when {d} < 1 then (4 - 6 * {d} * {d} + 3 * {d} * {d} * {d}) / 6 else (2 - {d}) * (2 - {d}) * (2 - {d}) / 6 end)",
    }[order]


def first_sql(order: int, s: str) -> str:
    """The first grid line of the stencil around s (in cells)."""
    return f"cast(floor({s} + 0.5) as bigint) - {(order - 1) // 2}" if order % 2 else f"cast(floor({s}) as bigint) - {order // 2 - 1}"


def _stencil(s: Column, order: int, n: int) -> Column:
    """Grid lines that a point at s (in cells) touches, with weights."""
    first = F.floor(s + 0.5) - (order - 1) // 2 if order % 2 else F.floor(s) - (order // 2 - 1)

    def weight(o: Column) -> Column:
        d = F.abs(s - (first + o))
        w = {
            1: F.lit(1.0),
            2: 1 - d,
            3: F.when(d < 0.5, 0.75 - d * d).otherwise(0.5 * (1.5 - d) * (1.5 - d)),
            4: F.when(d < 1, (4 - 6 * d * d + 3 * d * d * d) / 6).otherwise((2 - d) * (2 - d) * (2 - d) / 6),
        }[order]
        return F.struct(F.pmod(first + o, F.lit(n)).cast("int").alias("i"), w.cast("double").alias("w"))

    return F.array(*[weight(F.lit(o)) for o in range(order)])


def spread(df: DataFrame, n: Cells, box: Sides, window: str, keep: list[Column], shift: float = 0.0) -> DataFrame:
    """One row for each point and cell that it touches: ix, iy, iz, w and the kept columns."""
    if window not in ORDERS:
        raise ValueError(f"unknown window {window}")
    order = ORDERS[window]
    names = [k for k in df.select(*keep).columns]
    out = df.select(*keep, *[_stencil(F.col(a) * (c / side) + shift, order, c).alias(f"_{a}") for a, c, side in zip("xyz", three(n), three(box), strict=True)])
    for a in "xyz":
        rest = [c for c in out.columns if c != f"_{a}"]
        out = out.select(*rest, F.explode(f"_{a}").alias(f"_{a}"))
    return out.select(F.col("_x.i").alias("ix"), F.col("_y.i").alias("iy"), F.col("_z.i").alias("iz"), (F.col("_x.w") * F.col("_y.w") * F.col("_z.w")).alias("w"), *names)


def paint(df: DataFrame, n: Cells, box: Sides, window: str = "cic", weight: Column | float = 1.0, value: Column | float = 1.0, selection: Column | None = None, shift: float = 0.0) -> DataFrame:
    """Mass W * V of the selected points on the grid: (ix, iy, iz, v)."""
    src = df if selection is None else df.where(selection)
    w = (weight if isinstance(weight, Column) else F.lit(float(weight))) * (value if isinstance(value, Column) else F.lit(float(value)))
    src = src.withColumn("_m", w)
    return spread(src, n, box, window, [F.col("_m")], shift).groupBy(*CELL).agg(F.sum(F.col("w") * F.col("_m")).alias("v"))


def totals(df: DataFrame, box: Sides, weight: Column | float = 1.0, selection: Column | None = None) -> dict:
    """N, W, W2 and shotnoise = V * W2 / W^2 of the selected points."""
    src = df if selection is None else df.where(selection)
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    r = src.agg(F.count("*").alias("N"), F.coalesce(F.sum(w), F.lit(0.0)).alias("W"), F.coalesce(F.sum(w * w), F.lit(0.0)).alias("W2")).first()
    return {"N": r["N"], "W": r["W"], "W2": r["W2"], "shotnoise": volume(box) * r["W2"] / r["W"] ** 2 if r["W"] else float("nan")}


def density(mesh: DataFrame, n: Cells, total: float) -> DataFrame:
    """1 + delta on every cell: mass over the mean mass of a cell; 1 everywhere where there is no mass."""
    full = all_cells(mesh.sparkSession, n).join(mesh, CELL, "left")
    return full.select(*CELL, (F.coalesce("v", F.lit(0.0)) * (volume(n) / total) if total else F.lit(1.0)).alias("v"))


def all_cells(spark: SparkSession, n: Cells) -> DataFrame:
    nx, ny, nz = three(n)
    at = [F.expr(f"id div {ny * nz}"), F.expr(f"id div {nz} % {ny}"), F.col("id") % nz]
    return spark.range(nx * ny * nz).select(*[c.cast("int").alias(name) for c, name in zip(at, CELL, strict=True)])


def readout(df: DataFrame, mesh: DataFrame, n: Cells, box: Sides, window: str = "cic", values: Sequence[str] = ("v",)) -> DataFrame:
    """The named grids interpolated at each point: id and a column for each grid."""
    at = spread(df, n, box, window, [F.col("id")])
    return at.join(mesh.select(*CELL, *values), CELL, "left").groupBy("id").agg(*[F.sum(F.col("w") * F.coalesce(v, F.lit(0.0))).alias(v) for v in values])


def preview(mesh: DataFrame, axes: str = "xy") -> DataFrame:
    """The grid summed over the axes that are not named."""
    keys = [f"i{a}" for a in axes]
    return mesh.groupBy(*keys).agg(F.sum("v").alias("v"))


def _parts(values: Sequence[str]) -> list[tuple[str, str]]:
    """The columns of a grid's transform; a grid named v alone has re and im."""
    return [("re", "im")] if list(values) == ["v"] else [(f"re_{v}", f"im_{v}") for v in values]


def fft(mesh: DataFrame, n: Cells, values: Sequence[str] = ("v",)) -> DataFrame:
    """Forward transform of the named grids: by planes of ix, then by planes of iy; a task holds one plane of each."""
    nx, ny, nz = three(n)
    half, parts = nz // 2 + 1, _parts(values)

    def planes(pdf: pd.DataFrame) -> pd.DataFrame:
        iy, iz = np.divmod(np.arange(ny * half), half)
        out = {"ix": np.full(len(iy), pdf["ix"].iloc[0]), "iy": iy, "iz": iz}
        for v, (re, im) in zip(values, parts, strict=True):
            grid = np.zeros((ny, nz))
            np.add.at(grid, (pdf["iy"], pdf["iz"]), pdf[v])
            c = np.fft.rfft2(grid)
            out |= {re: c.real.ravel(), im: c.imag.ravel()}
        return pd.DataFrame(out)

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        ix, iz = np.divmod(np.arange(nx * half), half)
        out = {"ix": ix, "iy": np.full(len(ix), pdf["iy"].iloc[0]), "iz": iz}
        for re, im in parts:
            grid = np.zeros((nx, half), complex)
            grid[pdf["ix"], pdf["iz"]] = pdf[re] + 1j * pdf[im].to_numpy()
            c = np.fft.fft(grid, axis=0) / (nx * ny * nz)
            out |= {re: c.real.ravel(), im: c.imag.ravel()}
        return pd.DataFrame(out)

    schema = "ix int, iy int, iz int, " + ", ".join(f"{c} double" for p in parts for c in p)
    return mesh.select(*CELL, *values).groupBy("ix").applyInPandas(planes, schema).groupBy("iy").applyInPandas(lines, schema)


def ifft(modes: DataFrame, n: Cells, values: Sequence[str] = ("v",)) -> DataFrame:
    """Inverse transform of half spaces to the named real grids, without a factor."""
    nx, ny, nz = three(n)
    half, parts = nz // 2 + 1, _parts(values)

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        ix, iz = np.divmod(np.arange(nx * half), half)
        out = {"ix": ix, "iy": np.full(len(ix), pdf["iy"].iloc[0]), "iz": iz}
        for re, im in parts:
            grid = np.zeros((nx, half), complex)
            grid[pdf["ix"], pdf["iz"]] = pdf[re] + 1j * pdf[im].to_numpy()
            c = np.fft.ifft(grid, axis=0) * nx
            out |= {re: c.real.ravel(), im: c.imag.ravel()}
        return pd.DataFrame(out)

    def planes(pdf: pd.DataFrame) -> pd.DataFrame:
        iy, iz = np.divmod(np.arange(ny * nz), nz)
        out = {"ix": np.full(len(iy), pdf["ix"].iloc[0]), "iy": iy, "iz": iz}
        for v, (re, im) in zip(values, parts, strict=True):
            grid = np.zeros((ny, half), complex)
            grid[pdf["iy"], pdf["iz"]] = pdf[re] + 1j * pdf[im].to_numpy()
            out[v] = (np.fft.irfft2(grid, s=(ny, nz)) * (ny * nz)).ravel()
        return pd.DataFrame(out)

    columns = [c for p in parts for c in p]
    mid = modes.select(*CELL, *columns).groupBy("iy").applyInPandas(lines, "ix int, iy int, iz int, " + ", ".join(f"{c} double" for c in columns))
    return mid.groupBy("ix").applyInPandas(planes, "ix int, iy int, iz int, " + ", ".join(f"{v} double" for v in values))


def signed_modes(n: Cells) -> list[Column]:
    """Signed mode numbers of the half space's places."""
    return [F.when(F.col(c) > (m - 1) // 2, F.col(c) - m).otherwise(F.col(c)) if c != "iz" else F.col(c) for c, m in zip(CELL, three(n), strict=True)]


def with_wavenumbers(modes: DataFrame, n: Cells, box: Sides, los: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """Adds signed mode numbers nx, ny, nz, wavenumbers qx, qy, qz and their square n2 in units of the longest side's, k, mu (0 at k = 0) and the Hermitian weight h.

    In a cube q are the mode numbers and n2 is a whole number.
    """
    q = [F.col(c) if r == 1 else F.col(c) * r for c, r in zip(("nx", "ny", "nz"), ratios(box), strict=True)]
    nz = three(n)[2]
    m = modes.withColumns(dict(zip(("nx", "ny", "nz"), signed_modes(n), strict=True))).withColumns(dict(zip(("qx", "qy", "qz"), q, strict=True)))
    n2 = F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy") + F.col("qz") * F.col("qz")
    m = m.withColumn("n2", n2).withColumn("k", F.sqrt("n2") * (2 * math.pi / max(three(box))))
    dot = sum((F.col(c) * v for c, v in zip(("qx", "qy", "qz"), los, strict=True)), F.lit(0.0))
    mirrored = (F.col("iz") > 0) & ((F.col("iz") < nz // 2) if nz % 2 == 0 else F.lit(True))
    return m.withColumns({"mu": F.when(F.col("n2") == 0, 0.0).otherwise(dot / F.sqrt("n2")), "h": F.when(mirrored, 2).otherwise(1)})


def apply_filter(modes: DataFrame, n: Cells, box: Sides, factor: Callable[[Column], Column]) -> DataFrame:
    """Multiplies modes by a function of k given as a Column."""
    m = with_wavenumbers(modes, n, box)
    f = factor(F.col("k"))
    return m.select(*CELL, (F.col("re") * f).alias("re"), (F.col("im") * f).alias("im"))


def window_power(n: Cells, window: str, interlaced: bool = False) -> Column:
    """The window's squared size at modes with nx, ny, nz: with interlacing sinc^2p, else the form that also allows for aliased shot noise."""
    p, f = ORDERS[window], F.lit(1.0)
    if p == 1:
        raise ValueError("no compensation for ngp")
    for c, cells in zip(("nx", "ny", "nz"), three(n), strict=True):
        half = F.col(c) * (math.pi / cells)
        if interlaced:
            f = f * F.when(F.col(c) == 0, 1.0).otherwise(F.pow(F.sin(half) / half, F.lit(2.0 * p)))
        else:
            s = F.sin(half) * F.sin(half)
            f = f * {2: 1 - 2 / 3 * s, 3: 1 - s + 2 / 15 * s * s, 4: 1 - 4 / 3 * s + 2 / 5 * s * s - 4 / 315 * s * s * s}[p]
    return f


def compensate(modes: DataFrame, n: Cells, box: Sides, window: str, interlaced: bool = False) -> DataFrame:
    """Divides modes by the window."""
    f = F.sqrt(window_power(n, window, interlaced))
    return with_wavenumbers(modes, n, box).select(*CELL, (F.col("re") / f).alias("re"), (F.col("im") / f).alias("im"))


def interlace(first: DataFrame, second: DataFrame, n: Cells, box: Sides) -> DataFrame:
    """Mean of the modes of two paintings, the second one shifted by half a cell (shift=0.5) and turned back."""
    m = with_wavenumbers(first.join(second.select(*CELL, F.col("re").alias("re2"), F.col("im").alias("im2")), CELL), n, box)
    phase = sum((F.col(c) * (math.pi / cells) for c, cells in zip(("nx", "ny", "nz"), three(n), strict=True)), F.lit(0.0))
    c, s = F.cos(phase), F.sin(phase)
    return m.select(*CELL, (0.5 * (F.col("re") + F.col("re2") * c - F.col("im2") * s)).alias("re"), (0.5 * (F.col("im") + F.col("re2") * s + F.col("im2") * c)).alias("im"))


def resample(modes: DataFrame, n: Cells, to: Cells) -> DataFrame:
    """Modes of a grid of another size: those that both grids have, axis by axis.

    An even grid's edge mode stands for both of its signs. A larger grid gets half of it at each sign, a
    smaller one the sum of both signs; so a grid comes back unchanged from a larger one.
    """
    m = modes.select(*[c.alias(a) for c, a in zip(signed_modes(n), "xyz", strict=True)], "re", "im")
    for a, old, new in zip("xyz", three(n), three(to), strict=True):
        at = F.col(a)
        if new > old and old % 2 == 0:
            edge = F.abs(at) * 2 == old
            m = m.withColumns({c: F.when(edge, F.col(c) / 2).otherwise(F.col(c)) for c in ("re", "im")})
            if a != "z":  # the half space has one sign
                m = m.withColumn(a, F.explode(F.when(edge, F.array(at, -at)).otherwise(F.array(at))))
        elif new < old:
            m = m.where(F.abs(at) * 2 <= new if new % 2 == 0 else F.abs(at) * 2 < new)
            if a == "z" and new % 2 == 0:
                own, other = F.struct("x", "y", "re", "im"), F.struct((-F.col("x")).alias("x"), (-F.col("y")).alias("y"), F.col("re"), (-F.col("im")).alias("im"))
                m = m.select("z", F.explode(F.when(at * 2 == new, F.array(own, other)).otherwise(F.array(own))).alias("s")).select("s.x", "s.y", "z", "s.re", "s.im")
    # Mirrored rows may lie at signs that the axes cut before have folded, so places are taken last.
    at = [(F.pmod(F.col(a), F.lit(c)) if a != "z" else F.col(a)).cast("int").alias(i) for a, i, c in zip("xyz", CELL, three(to), strict=True)]
    return m.select(*at, "re", "im").groupBy(*CELL).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def from_array(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """A grid from a small array."""
    ix, iy, iz = np.indices(values.shape).reshape(3, -1)
    return spark.createDataFrame(pd.DataFrame({"ix": ix.astype(np.int32), "iy": iy.astype(np.int32), "iz": iz.astype(np.int32), "v": values.ravel().astype(float)}))
