"""Pair counts and two-point correlation functions."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.cosmology import Cosmology, sky_to_comoving
from skyloom.functions.sky import legendre, to_unit_sphere, ylm_powers, ylm_values
from skyloom.operators.box import Sides, three, volume
from skyloom.operators.spatial import Patch, Tile, block_sums, sum_squares
from skyloom.plans.scratch import Scratch

if TYPE_CHECKING:
    from skyloom.catalog import Catalog


def check_edges(edges: list[float], mode: str, n_mu: int | None = None, pimax: float | None = None) -> None:
    if mode not in ("1d", "2d", "projected", "angular"):
        raise ValueError(f"unknown mode {mode}")
    if len(edges) < 2 or edges[0] <= 0 or list(edges) != sorted(edges):
        raise ValueError("edges must rise from above 0, so that no point pairs with itself")
    if mode == "2d" and not n_mu:
        raise ValueError("mode 2d needs n_mu")
    if mode == "projected" and (pimax is None or pimax < 1):
        raise ValueError("mode projected needs pimax >= 1")


def _counted(a: DataFrame, b: DataFrame, edges: list[float], reach: tuple[float, float, float], box: Sides | None, bins: Callable[..., tuple[np.ndarray, np.ndarray | None]], keys: tuple[str, ...], half: bool, groups: tuple[tuple[int, ...], ...] = ((0, 1, 2),), means: bool = True) -> DataFrame:
    """Counts by separation [lo, hi): r_bin (and bin2), npairs, wnpairs (sum of weight products), the mean separation.

    Without means, and where bins are of the separation in space alone, tables of a tile are counted whole (see _tables).

    Each block is added up by itself, so rows are bins. bins() makes the separation and a second bin (negative for none)
    of pairs from the squares of their gaps, the gaps and the sums of both positions. Each pair of a half counts twice.
    """
    times, n_r = 2 if half else 1, len(edges) - 1
    if not means:
        sums = block_sums(a, b, _tables(edges, half), "r_bin int, n long, w double", reach, box, ["w"], ["w"], half, groups, POINTS_A_COUNT if groups == ((0, 1, 2),) else 0)
        return Scratch(a.sparkSession).keep(sums.groupBy("r_bin").agg(F.sum("n").alias("npairs"), F.sum("w").alias("wnpairs")), "counts")

    def run(x: pd.DataFrame, y: pd.DataFrame, tiles: Iterator[Tile]) -> pd.DataFrame:
        found = {}
        w1, w2 = x["w1"].to_numpy(float), y["w2"].to_numpy(float)
        id1, id2, own = x["id1"].to_numpy(), y["id2"].to_numpy(), y["own"].to_numpy(bool)
        at = [(x[f"{c}1"].to_numpy(float), y[f"{c}2"].to_numpy(float)) for c in "xyz"]
        for t in tiles:
            with np.errstate(invalid="ignore", divide="ignore"):
                s, second = bins(sum_squares([t.gaps[k] for k in groups[0]]), lambda t=t: t.gaps, lambda t=t: [p[t.rows][:, None] + q[t.near] for p, q in at])
            if half and (within := np.flatnonzero(own[t.near])).size:
                s[:, within] = np.where(id1[t.rows][:, None] < id2[t.near[within]], s[:, within], 0.0)
            # The first and the last column of bins and the first row hold what is in none.
            code = np.zeros(s.shape, np.int32) if second is None else (second + 1) * (n_r + 2)
            for e in edges:
                code += s >= e
            code, w, s = code.ravel().astype(np.intp), (w1[t.rows][:, None] * w2[t.near]).ravel(), s.ravel()
            for name, v in (("n", None), ("w", w), ("s", s)):
                new = np.bincount(code, v)
                old = found.get(name, new[:0])
                long, short = (new, old) if len(new) >= len(old) else (old, new)
                long[: len(short)] += short
                found[name] = long
        n, first = found.get("n", np.zeros(0, np.int64)), 0 if "bin2" not in keys else 1
        seen = np.flatnonzero(n)
        column, row = seen % (n_r + 2) - 1, seen // (n_r + 2) - first
        use = (column >= 0) & (column < n_r) & (row >= 0)
        seen, column, row = seen[use], column[use], row[use]
        return pd.DataFrame({"r_bin": column.astype(np.int32), "bin2": row.astype(np.int32), "n": n[seen], "w": found["w"][seen] if len(seen) else 0.0, "s": found["s"][seen] if len(seen) else 0.0}, index=range(len(seen)))

    sums = block_sums(a, b, run, "r_bin int, bin2 int, n long, w double, s double", reach, box, ["w"], ["w"], half, groups)
    found = sums.groupBy(*keys).agg((F.sum("n") * times).alias("npairs"), (F.sum("w") * times).alias("wnpairs"), (F.sum("s") / F.sum("n")).alias("r"))
    # Few rows that cost all pairs: written, as a table of bins is read more than once.
    return Scratch(a.sparkSession).keep(found, "counts")


#: Places of a patch that are worked out at a time, about, and the points of a patch whose pairs are counted.
PLACES, POINTS_A_COUNT = 1 << 15, 24


def _least_square(edge: float) -> float:
    """The smallest number whose square root is the edge or more."""
    x = edge * edge
    while math.sqrt(x) >= edge:
        x = math.nextafter(x, 0.0)
    while math.sqrt(x) < edge:
        x = math.nextafter(x, math.inf)
    return x


def _tables(edges: list[float], half: bool) -> Callable[[pd.DataFrame, pd.DataFrame, Iterator[Tile]], pd.DataFrame]:
    """For block_sums: ordered pairs and sums of weight products by bins of the separation.

    For each edge, a table of what is as far or farther is multiplied by the weights of both sides, so that no pair is picked out.
    Of a patch, only points are measured whose separations may be on both sides of the edge; farther ones are added up whole. With half, a pair across two cells comes once and counts twice, one within a cell comes in both orders.
    """
    squares = [_least_square(e) for e in edges]

    def run(x: pd.DataFrame, y: pd.DataFrame, tiles: Iterator[Tile | Patch]) -> pd.DataFrame:
        id1, id2, own = x["id1"].to_numpy(), y["id2"].to_numpy(), y["own"].to_numpy(bool)
        times = np.where(own, 1.0, 2.0) if half else np.ones(len(y))
        left, right = np.stack([np.ones(len(x)), x["w1"].to_numpy(float)]), np.stack([times, times * y["w2"].to_numpy(float)])
        repeats, far = half and len(np.unique(id1)) < len(id1), np.zeros((len(squares), 2))
        for t in tiles:
            of, by = left[:, t.rows], right[:, t.near].T
            if isinstance(t, Patch):
                same = own[t.near][None] & (id1[t.rows][:, None] == id2[t.near][None]) if repeats else None
                far += _far(t, edges, squares, of, by, same)
                continue
            s2 = t.squared()
            if repeats:
                s2[own[t.near][None] & (id1[t.rows][:, None] == id2[t.near][None])] = -1.0
            for k, least in enumerate(squares):
                far[k] += np.einsum("ki,ik->k", of, (s2 >= least).astype(float) @ by)
        found = far[:-1] - far[1:]
        return pd.DataFrame({"r_bin": np.arange(len(found), dtype=np.int32), "n": np.rint(found[:, 0]).astype(np.int64), "w": found[:, 1]})[found[:, 0] > 0]

    return run


def _far(p: Patch, edges: list[float], squares: list[float], of: np.ndarray, by: np.ndarray, same: np.ndarray | None) -> np.ndarray:
    """Sums over the pairs of a patch that are as far as each edge or farther, without those that are the same point."""
    low, high = p.own.min(axis=0), p.own.max(axis=0)
    half, ways = math.sqrt(sum_squares(list((high - low) / 2))), np.sqrt(sum_squares(list(p.images() - ((low + high) / 2)[:, None])))
    # In order but for rounding.
    ways = np.maximum.accumulate(ways)
    found, step, ranges = np.zeros((len(edges), 2)), max(PLACES // len(p.rows), 1), []
    tables = np.empty((2, len(p.rows), min(step, len(p.near))))
    for k, edge in enumerate(edges):
        spare = 1e-9 * (edge + half)
        first, last = (int(v) for v in np.searchsorted(ways, (edge - half - spare, edge + half + spare))) if same is None else (0, len(ways))
        found[k] = of.sum(axis=1) * by[last:].sum(axis=0)
        ranges.append((first, last))
    for a in range(0, len(ways), step):
        about = [(k, max(first, a), min(last, a + step)) for k, (first, last) in enumerate(ranges) if first < a + step and last > a]
        if not about:
            continue
        start = min(first for _, first, _ in about)
        cut = slice(start, max(last for *_, last in about))
        s2, spare = tables[:, :, : cut.stop - start]
        p.squared(cut, s2, spare)
        if same is not None:
            s2[same[:, cut]] = -1.0
        for k, first, last in about:
            one = spare[:, : last - first]
            np.copyto(one, s2[:, first - start : last - start] >= squares[k])
            found[k] += np.einsum("ki,ik->k", of, one @ by[first:last])
    return found


def _places(x: np.ndarray) -> np.ndarray:
    """Whole numbers; pairs at no distance have none."""
    return np.floor(np.fmax(x, -1.0)).astype(np.int32)


def _binned(s: np.ndarray, along: Callable[[], np.ndarray], n_mu: int | None, pimax: float | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Separations with bins of |mu| (1 in the last) or of width 1 along the line of sight, up to pimax."""
    if pimax is not None:
        far = along()
        return s, np.where(far < pimax, _places(far), -1)
    return s, None if n_mu is None else np.minimum(_places(along() / s * n_mu), n_mu - 1)


#: The keys of counts by mode.
KEYS = {"1d": ("r_bin",), "angular": ("r_bin",), "2d": ("r_bin", "bin2"), "projected": ("r_bin", "bin2")}


def _both(first: DataFrame, second: DataFrame | None, prepare: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a count; one table twice for pairs within it."""
    a = prepare(first)
    return a, a if second is None else prepare(second)


def box_pairs(first: DataFrame, edges: list[float], box: Sides | None, second: DataFrame | None = None, mode: str = "1d", los: str = "z", n_mu: int | None = None, pimax: float | None = None, weight: str | None = None, means: bool = True) -> DataFrame:
    """Ordered pair counts in a box (periodic if box is given). Without means, counts by the separation alone leave its mean out.

    2d adds bin2 over |mu| in [0, 1] (mu = 1 in the last bin), projected bins the separation across the
    line of sight and adds bin2 of width 1 along it up to pimax. Positions x, y, z.
    """
    check_edges(edges, mode, n_mu, pimax)
    if box is not None and edges[-1] > min(three(box)) / 2:
        raise ValueError("a periodic count needs its largest separation within half the box")
    own = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    sides = _both(first, second, lambda d: d.select("id", *"xyz", own.alias("w")))
    reach, k, groups = [edges[-1]] * 3, "xyz".index(los), ((0, 1, 2),)
    if mode == "projected":
        reach[k], groups = pimax, (tuple(a for a in range(3) if a != k), (k,))
    wedges, layers = (n_mu if mode == "2d" else None), (pimax if mode == "projected" else None)
    return _counted(*sides, edges, tuple(reach), box, lambda s2, gaps, sums: _binned(np.sqrt(s2), lambda: np.abs(gaps()[k]), wedges, layers), KEYS[mode], second is None, groups, means or mode != "1d")


def survey_pairs(first: DataFrame, edges: list[float], second: DataFrame | None = None, mode: str = "1d", n_mu: int | None = None, pimax: float | None = None, weight: str | None = None, cosmo: Cosmology | None = None, means: bool = True) -> DataFrame:
    """Pair counts of comoving positions x, y, z seen from the origin; the line of sight is that of the pair's midpoint.

    With a cosmology, positions are made from ra, dec (degrees) and redshift.
    """
    check_edges(edges, mode, n_mu, pimax)
    if cosmo:
        first, second = (d if d is None else d.withColumns(dict(zip("xyz", sky_to_comoving(cosmo, F.col("ra"), F.col("dec"), F.col("redshift")), strict=True))) for d in (first, second))
    far = edges[-1] if mode != "projected" else math.hypot(edges[-1], pimax)
    own = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    sides = _both(first, second, lambda d: d.select("id", own.alias("w"), *"xyz"))

    wedges, layers = (n_mu if mode == "2d" else None), (pimax if mode == "projected" else None)

    def bins(s2: np.ndarray, gaps: Callable[[], list[np.ndarray]], sums: Callable[[], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray | None]:
        if mode == "1d":
            return np.sqrt(s2), None
        middle = sums()
        along = np.abs(sum(d * m for d, m in zip(gaps(), middle, strict=True)) / np.sqrt(sum(m * m for m in middle)))
        s = np.sqrt(s2) if mode == "2d" else np.sqrt(np.maximum(s2 - along * along, 0.0))
        return _binned(s, lambda: along, wedges, layers)

    return _counted(*sides, edges, (far,) * 3, None, bins, KEYS[mode], second is None, means=means or mode != "1d")


def angular_pairs(first: DataFrame, edges: list[float], second: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """Pair counts by angle in degrees of sky positions ra, dec: chords 2 sin(angle / 2) on the unit sphere."""
    check_edges(edges, "angular")
    x, y, z = to_unit_sphere(F.col("ra"), F.col("dec"))
    own = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    sides = _both(first, second, lambda d: d.select("id", own.alias("w"), x.alias("x"), y.alias("y"), z.alias("z")))
    chord = 2 * math.sin(math.radians(min(edges[-1], 180.0)) / 2)
    return _counted(*sides, edges, (chord,) * 3, None, lambda s2, gaps, sums: (np.degrees(2 * np.arcsin(np.minimum(np.sqrt(s2) / 2, 1.0))), None), KEYS["angular"], second is None)


def total_weight(first: DataFrame, second: DataFrame | None = None, weight: str | None = None) -> float:
    """Weight of all pairs: (W1^2 - sum W^2) / 2 within one catalog, W1 W2 / 2 across two, each doubled here because pairs are ordered."""
    w = F.col(weight) if weight else F.lit(1.0)
    a = first.agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2")).first()
    if second is None:
        return a["w"] ** 2 - a["w2"]
    return a["w"] * second.agg(F.sum(w).alias("w")).first()["w"]


def natural(counts: DataFrame, n: int, box: Sides | None, edges: list[float], n_mu: int | None = None, mode: str = "1d") -> DataFrame:
    """xi = DD / RR - 1 with the analytic count of uniform randoms.

    In a box: in each shell (1d), wedge of a shell (2d) or ring of width 1 at both signs along the line of sight
    (projected). Angular counts are compared with a uniform sky.
    """
    steps = list(zip(edges[:-1], edges[1:], strict=True))
    if mode == "angular":
        share = [(math.cos(math.radians(a)) - math.cos(math.radians(b))) / 2 for a, b in steps]
    elif mode == "projected":
        share = [2 * math.pi * (b * b - a * a) / volume(box) for a, b in steps]
    else:
        share = [4 / 3 * math.pi * (b**3 - a**3) / (n_mu or 1) / volume(box) for a, b in steps]
    rr = F.element_at(F.array(*[F.lit(v * n * (n - 1)) for v in share]), F.col("r_bin") + 1)
    return counts.withColumn("rr", rr).withColumn("corr", F.col("wnpairs") / F.col("rr") - 1)


def spherical_volume(df: DataFrame, box: Sides) -> DataFrame:
    """The points nearer to the box's centre than half of its shortest side."""
    sides = three(box)
    r2 = sum(((F.col(a) - s / 2) * (F.col(a) - s / 2) for a, s in zip("xyz", sides, strict=True)), F.lit(0.0))
    return df.where(F.sqrt(r2) < min(sides) / 2)


def check_sources(first: Catalog, second: Catalog | None = None, box: Sides | None = None, columns: tuple[str, ...] = ("x", "y", "z")) -> tuple[float, ...]:
    """The box of a count, given or from the catalogs' BoxSize; columns must be there and boxes agree."""
    found = None if box is None else tuple(map(float, three(box)))
    for c in (first, first if second is None else second):
        if missing := [name for name in columns if name not in c.columns]:
            raise ValueError(f"missing columns {missing}")
        own = c.attrs.get("BoxSize")
        if own is not None:
            own = tuple(map(float, three(own)))
            if found is not None and own != found:
                raise ValueError(f"boxes differ: {own} and {found}")
            found = own
    if found is None:
        raise ValueError("a box is needed, as an argument or as the attribute BoxSize")
    return found


def landy_szalay(dd: DataFrame, dr: DataFrame, rr: DataFrame, total_dd: float, total_dr: float, total_rr: float, rd: DataFrame | None = None, total_rd: float | None = None) -> DataFrame:
    """xi = (DD - DR - RD) / RR + 1 with each count over its total; null where RR is empty. RD is DR unless given."""
    keys = [c for c in ("r_bin", "bin2") if c in rr.columns]
    out = rr.select(*keys, (F.col("wnpairs") / total_rr).alias("rr"))
    for name, t, total in (("dd", dd, total_dd), ("dr", dr, total_dr), ("rd", dr if rd is None else rd, total_rd or total_dr)):
        out = out.join(t.select(*keys, (F.col("wnpairs") / total).alias(name)), keys, "full")
    z = {c: F.coalesce(c, F.lit(0.0)) for c in ("dd", "dr", "rd")}
    return out.withColumn("corr", F.when(F.col("rr") > 0, (z["dd"] - z["dr"] - z["rd"]) / F.col("rr") + 1))


def survey_correlation(data: DataFrame, randoms: DataFrame, edges: list[float], mode: str = "1d", n_mu: int | None = None, pimax: float | None = None, weight: str | None = None, cosmo: Cosmology | None = None, second: DataFrame | None = None, second_randoms: DataFrame | None = None) -> DataFrame:
    """xi of a survey with its randoms by Landy and Szalay, from x, y, z or, with a cosmology, ra, dec and redshift; mode angular takes ra and dec.

    With a second catalog (its randoms are those of the first unless given) the cross-correlation.
    """
    other, others = data if second is None else second, randoms if second_randoms is None else second_randoms

    def count(a: DataFrame, b: DataFrame) -> tuple[DataFrame, float]:
        b = None if b is a else b
        pairs = angular_pairs(a, edges, b, weight) if mode == "angular" else survey_pairs(a, edges, b, mode, n_mu, pimax, weight, cosmo, False)
        return pairs, total_weight(a, b, weight)

    (dd, tdd), (dr, tdr), (rr, trr) = count(data, other), count(data, others), count(randoms, others)
    rd, trd = (None, None) if second is None else count(other, randoms)
    return landy_szalay(dd, dr, rr, tdd, tdr, trr, rd, trd)


def wp(corr: DataFrame, width: float = 1.0) -> DataFrame:
    """Projected correlation function: sum of 2 xi over the bins along the line of sight."""
    return corr.groupBy("r_bin").agg(F.sum(2 * F.col("corr") * width).alias("wp"))


def corr_poles(corr: DataFrame, n_mu: int, poles: tuple[int, ...]) -> DataFrame:
    """Multipoles from wedges of |mu|: (2 l + 1) sum xi L_l(mu) / n_mu."""
    mu = (F.col("bin2") + 0.5) / n_mu
    return corr.groupBy("r_bin").agg(*[(F.sum(F.col("corr") * legendre(ell, mu)) * ((2 * ell + 1) / n_mu)).alias(f"corr_{ell}") for ell in poles])


#: Points of a patch, about; up to which pole and how many bins patches are quicker than pairs.
POINTS_A_PATCH, MOST_POLE, MOST_BINS = 80, 4, 8


def _powers(ell: int) -> list[tuple[int, int, int]]:
    return sorted((p for p in itertools.product(range(ell + 1), repeat=3) if sum(p) <= ell), key=lambda p: (sum(p), p))


def _monomials(x: np.ndarray, powers: list[tuple[int, int, int]]) -> np.ndarray:
    """Products of powers of three coordinates (the rows of x), a row for each; powers by their degree, all up to the most."""
    out, number = np.ones((len(powers), x.shape[1])), {p: i for i, p in enumerate(powers)}
    for i, p in enumerate(powers[1:], 1):
        axis = next(a for a in range(3) if p[a])
        np.multiply(out[number[tuple(v - (a == axis) for a, v in enumerate(p))]], x[axis], out=out[i])
    return out


def _moved_harmonics(ell: int) -> np.ndarray:
    """Coefficients c[e, m, k] with s^l Y_lm((p - q) / s) = sum over e and k of c[e, m, k] p^e q^k, powers as in _powers(l)."""
    powers = _powers(ell)
    number, out = {p: i for i, p in enumerate(powers)}, np.zeros((len(powers), 2 * ell + 1, len(powers)))
    for m in range(-ell, ell + 1):
        for top, c in ylm_powers(ell, m).items():
            for k in itertools.product(*[range(t + 1) for t in top]):
                ways = math.prod(math.comb(t, i) for t, i in zip(top, k, strict=True))
                out[number[tuple(t - i for t, i in zip(top, k, strict=True))], m + ell, number[k]] += c * ways * (-1) ** sum(k)
    return out


class _Moments:
    """Sums of w Y_lm by bins (lo, hi] of the separation for the points of a patch, by products of matrices.

    s^l Y_lm is a polynomial of the difference of two places, so that of products of their powers: tables of s^-l, one for each bin,
    are multiplied by w and powers of the near places, and the sums by powers of the own ones. Near to a point, where that
    loses digits, and for what is no patch, harmonics are worked out pair by pair.
    """

    def __init__(self, edges: list[float], poles: tuple[int, ...]):
        self.edges, self.poles, self.bins = edges, poles, len(edges) - 1
        self.at = [(ell, m) for ell in poles for m in range(-ell, ell + 1)]
        self.low, self.high = max(edges[0], 0.0) ** 2, edges[-1] ** 2
        # What is not farther than an edge; separations are compared inside, their squares at both ends.
        self.squares = [self.low, *(math.nextafter(_least_square(math.nextafter(e, math.inf)), 0.0) if e > 0 else -1.0 for e in edges[1:-1]), self.high]
        self.beside = (edges[-1] / 16) ** 2
        self.moved = {ell: _moved_harmonics(ell) for ell in poles}

    def pairs(self, rows: np.ndarray, s2: np.ndarray, gaps: list[np.ndarray], w: np.ndarray, n: np.ndarray, sums: np.ndarray) -> None:
        """Adds pairs one by one: the rows' places and, for each pair, its square, gaps and weight."""
        s = np.sqrt(s2)
        # Bins are (lo, hi].
        code = rows * self.bins + sum((s > e for e in self.edges[1:-1]), np.zeros(len(s), np.int64))
        u = [g / s for g in gaps]
        n += np.bincount(code, minlength=n.size).reshape(n.shape)
        for k, (ell, m) in enumerate(self.at):
            sums[k] += np.bincount(code, w * ylm_values(ell, m, *u), n.size).reshape(n.shape)

    def tile(self, t: Tile, w: np.ndarray, n: np.ndarray, sums: np.ndarray) -> None:
        s2 = t.squared()
        flat = np.flatnonzero((s2 > self.low) & (s2 <= self.high))
        i, j = np.divmod(flat, len(t.near))
        part, found = np.zeros((len(t.rows), self.bins), np.int64), np.zeros((len(self.at), len(t.rows), self.bins))
        self.pairs(i, s2.ravel()[flat], [g.ravel()[flat] for g in t.gaps], w[t.near[j]], part, found)
        n[t.rows] += part
        sums[:, t.rows] += found

    def patch(self, p: Patch, w: np.ndarray, n: np.ndarray, sums: np.ndarray) -> None:
        size, w = len(p.rows), w[p.near]
        middle = (p.own.min(axis=0) + p.own.max(axis=0)) / 2
        terms = {ell: math.comb(ell + 3, 3) for ell in self.poles}
        right = _monomials(p.images() - middle[:, None], _powers(max(self.poles)))
        right *= w
        left = {ell: np.zeros((self.bins, size, k)) for ell, k in terms.items()}
        part, found = np.zeros((size, self.bins), np.int64), np.zeros((len(self.at), size, self.bins))
        step, beside = max(PLACES // size, 1), []
        tables = np.empty((4, size, min(step, len(p.near))))
        for a in range(0, len(p.near), step):
            cut = slice(a, min(a + step, len(p.near)))
            s2, spare, one, other = tables[:, :, : cut.stop - a]
            p.squared(cut, s2, spare)
            least, most = s2.min(), s2.max()
            if least <= self.beside:
                i, j = np.nonzero(near := s2 <= self.beside)
                use = s2[i, j] > self.low
                beside.append((i[use], a + j[use], s2[i[use], j[use]]))
                s2[near] = np.inf
                most = np.inf
            inverse = np.divide(1.0, s2, out=spare)
            for b, (above, upto) in enumerate(itertools.pairwise(self.squares)):
                if most <= above or least > upto:
                    continue
                if all_ := least > above and most <= upto:
                    part[:, b] += cut.stop - a
                    even, power = inverse, 2
                else:
                    seen = s2 <= upto
                    if least <= above:
                        seen &= s2 > above
                    np.copyto(one, seen)
                    part[:, b] += one.sum(axis=1).astype(np.int64)
                    even, power = one, 0
                for ell in sorted(self.poles):
                    if all_ and ell < 2:
                        left[ell][b] += (right[: terms[ell], cut].sum(axis=1) if ell == 0 else np.sqrt(inverse, out=other) @ right[: terms[ell], cut].T)
                        continue
                    while power + 2 <= ell:
                        even, power = np.multiply(even, inverse, out=one), power + 2
                    table = even
                    if power < ell:
                        table = np.sqrt(inverse, out=other)
                        table *= even
                    left[ell][b] += table @ right[: terms[ell], cut].T
        if beside:
            i, j, s2 = (np.concatenate(v) for v in zip(*beside, strict=True))
            gaps = [p.own[i, k] - p.there[k, j] - (0.0 if p.moved[k] is None else p.moved[k][j]) for k in range(3)]
            self.pairs(i, s2, gaps, w[j], part, found)
        k = 0
        for ell in self.poles:
            c = np.tensordot(_monomials(p.own.T - middle[:, None], _powers(ell)), self.moved[ell], (0, 0))
            found[k : k + 2 * ell + 1] += np.einsum("imk,bik->mib", c, left[ell])
            k += 2 * ell + 1
        n[p.rows] += part
        sums[:, p.rows] += found


def triplet_poles(first: DataFrame, edges: list[float], poles: tuple[int, ...], box: Sides | None = None, second: DataFrame | None = None, weight: str | None = None, cosmo: Cosmology | None = None) -> DataFrame:
    """Three-point multipoles: sum over triplets of w w' w'' L_l(cos angle at the primary), by the bins of both sides.

    zeta_l(b1, b2) = sum_i w_i sum_jk w_j w_k (2 l + 1) / (4 pi)^2 P_l(r_ij . r_ik), bins (lo, hi], j = k included.
    Triplets are never made: by the addition theorem the sum over j and k is that over m of
    A_lm(b1) A_lm(b2) / (4 pi), with A_lm(b) = sum_j w_j Y_lm(r_ij) over the neighbours of a primary in a bin. Each block
    adds its pairs to the moments of its primaries, so that no pair is a row, and moments are multiplied for each
    primary. With a cosmology, positions are made from ra, dec (degrees) and redshift.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)

    def prepare(d: DataFrame) -> DataFrame:
        if cosmo:
            d = d.withColumns(dict(zip("xyz", sky_to_comoving(cosmo, F.col("ra"), F.col("dec"), F.col("redshift")), strict=True)))
        return d.withColumn("w", w)

    moments, n_b = _Moments(edges, poles), len(edges) - 1
    at = moments.at

    def run(x: pd.DataFrame, y: pd.DataFrame, tiles: Iterator[Tile | Patch]) -> pd.DataFrame:
        w2, n, sums = y["w2"].to_numpy(float), np.zeros((len(x), n_b), np.int64), np.zeros((len(at), len(x), n_b))
        for t in tiles:
            (moments.patch if isinstance(t, Patch) else moments.tile)(t, w2, n, sums)
        i, b = np.nonzero(n)
        return pd.DataFrame({"id1": x["id1"].to_numpy()[i], "w1": x["w1"].to_numpy(float)[i], "b": b.astype(np.int32), **{f"m{k}": sums[k, i, b] for k in range(len(at))}})

    names = [f"m{k}" for k in range(len(at))]
    p = block_sums(*_both(first, second, prepare), run, ", ".join(["id1 long, w1 double, b int", *(f"{m} double" for m in names)]), (edges[-1],) * 3, box, ["w"], ["w"], patches=POINTS_A_PATCH if max(poles) <= MOST_POLE and n_b <= MOST_BINS else 0)
    by_bin = p.groupBy("id1", "b").agg(F.first("w1").alias("w1"), F.array(*[F.sum(m) for m in names]).alias("a"))
    # A primary has no more rows than there are bins.
    sides = by_bin.groupBy("id1").agg(F.first("w1").alias("w1"), F.collect_list(F.struct("b", "a")).alias("own"))
    both = sides.select("w1", "own", F.explode("own").alias("p")).select("w1", "p", F.explode("own").alias("q"))
    product = [F.col("w1") * sum((F.col("p.a")[i] * F.col("q.a")[i] for i, (e, _) in enumerate(at) if e == ell), F.lit(0.0)) for ell in poles]
    return both.groupBy(F.col("p.b").alias("b1"), F.col("q.b").alias("b2")).agg(*[(F.sum(z) / (4 * math.pi)).alias(f"zeta_{ell}") for ell, z in zip(poles, product, strict=True)])
