"""A grid as an object: cells or modes, and a queue of filters that is replayed when the grid is computed."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import mesh as M
from skyloom.operators.box import Cells, Sides, three

#: A filter takes three coordinates and gives a factor, or its real and imaginary part.
Filter = Callable[[Column, Column, Column], Column | tuple[Column, Column]]
KINDS = {"real": ("relative", "index"), "complex": ("wavenumber", "circular", "index")}


class Mesh:
    """n cells (ix, iy, iz, v) in a box, each one number or one for each axis, or modes (ix, iy, iz, re, im); filters wait until compute()."""

    def __init__(self, df: DataFrame, n: Cells, box: Sides, mode: str = "real", attrs: dict | None = None, queue: tuple = ()):
        if mode not in KINDS:
            raise ValueError(f"unknown mode {mode}")
        self.df, self.n, self.box, self.mode, self.attrs, self.queue = df, three(n), tuple(map(float, three(box))), mode, dict(attrs or {}), tuple(queue)

    @classmethod
    def from_points(cls, df: DataFrame, n: Cells, box: Sides, window: str = "cic", weight: Column | float = 1.0, value: Column | float = 1.0, selection: Column | None = None, interlaced: bool = False, compensated: bool = False) -> Mesh:
        """1 + delta of the selected points; interlaced grids start as modes."""
        attrs = M.totals(df, box, weight, selection)
        grids = [M.density(M.paint(df, n, box, window, weight, value, selection, shift), n, attrs["W"]) for shift in ((0.0, 0.5) if interlaced else (0.0,))]
        modes = interlaced or compensated
        found = grids[0]
        if modes:
            found = M.fft(found, n)
            found = M.interlace(found, M.fft(grids[1], n), n, box) if interlaced else found
            found = M.compensate(found, n, box, window, interlaced) if compensated else found
        return cls(found, n, box, "complex" if modes else "real", attrs)

    def apply(self, factor: Filter, kind: str = "wavenumber", mode: str = "complex") -> Mesh:
        """The same grid with one more filter to come.

        Coordinates of modes: wavenumber (2 pi n / box), circular (2 pi n / cells along a side) or index
        (signed mode numbers); of cells: relative (distance from the origin) or index.
        """
        if mode not in KINDS or kind not in KINDS[mode]:
            raise ValueError(f"no coordinates {kind} for {mode}")
        return Mesh(self.df, self.n, self.box, self.mode, self.attrs, (*self.queue, (factor, kind, mode)))

    def compute(self, mode: str = "real", n: Cells | None = None) -> DataFrame:
        """Cells or modes after all filters in their order; transforms only where a filter needs the other form.

        With n, the grid is resampled to so many cells at the end.
        """
        df, now = self.df, self.mode
        for factor, kind, wanted in self.queue:
            df, now = self._turn(df, now, wanted), wanted
            df = self._filtered(df, factor, kind, wanted)
        if n is None or three(n) == self.n:
            return self._turn(df, now, mode)
        df = M.resample(self._turn(df, now, "complex"), self.n, n)
        return df if mode == "complex" else M.ifft(df, n)

    def _turn(self, df: DataFrame, now: str, to: str) -> DataFrame:
        if to not in KINDS:
            raise ValueError(f"unknown mode {to}")
        return df if now == to else M.fft(df, self.n) if to == "complex" else M.ifft(df, self.n)

    def _filtered(self, df: DataFrame, factor: Filter, kind: str, mode: str) -> DataFrame:
        units = [{"index": 1, "relative": side / n, "wavenumber": 2 * math.pi / side, "circular": 2 * math.pi / n}[kind] for n, side in zip(self.n, self.box, strict=True)]
        if mode == "complex":
            df = M.with_wavenumbers(df, self.n, self.box)
        at = [F.col(c) * unit for c, unit in zip(("nx", "ny", "nz") if mode == "complex" else M.CELL, units, strict=True)]
        f = factor(*at)
        if mode == "real":
            return df.select(*M.CELL, (F.col("v") * f).alias("v"))
        re, im = f if isinstance(f, tuple) else (f, F.lit(0.0))
        return df.select(*M.CELL, (F.col("re") * re - F.col("im") * im).alias("re"), (F.col("re") * im + F.col("im") * re).alias("im"))

    def preview(self, axes: str = "xy") -> DataFrame:
        return M.preview(self.compute("real"), axes)

    def save(self, path: str, mode: str = "real") -> None:
        """The computed grid as Parquet, its size and attributes beside it as one JSON row."""
        self.compute(mode).write.mode("overwrite").parquet(f"{path}/cells")
        about = json.dumps({"n": self.n, "box": self.box, "mode": mode, "attrs": self.attrs})
        self.df.sparkSession.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Mesh:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return cls(spark.read.parquet(f"{path}/cells"), about["n"], about["box"], about["mode"], about["attrs"])
