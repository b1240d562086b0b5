"""Pairs within a radius, as an equi-join of cells with a residual distance.

Points are dealt to cells that are at least as wide as the reach, so that pairs lie in neighbour cells.
The work of a cell is the product of its points on both sides, and it is not even: the number of
partitions and the cut of dense cells follow from an estimate of it. A sample of bounded size gives a
histogram of both sides; a cell with more than its share of the work is cut into b x b blocks, each
joining one b-th of the left side with one b-th of the right side. No partition number is fixed, and no
task holds more than a small part of a dense cell, whatever the clustering.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.box import Sides, three
from skyloom.plans.scratch import Scratch

AXES = ("x", "y", "z")
CELLS = ["c0", "c1", "c2"]
#: Rows of the sample behind the histogram of a side, about.
SAMPLE = 200_000
#: Pairs of points that a task should look at, and the most partitions that are made for it.
PAIRS_A_TASK, MOST_PARTITIONS = 20_000_000, 20_000
#: Blocks that the work of one task is cut into, so that blocks can be dealt evenly.
BLOCKS_A_TASK = 8
#: The same where blocks are added up in their task and no pair is a row: cuts send points more often, so there are few.
PAIRS_A_SUM, BLOCKS_A_SUM = 2_000_000_000, 4
#: Rows of both sides that such a task should get and sort: blocks of few points have many rows for their pairs.
ROWS_A_SUM = 250_000
#: Rows that a task which deals points to such tasks should send: it holds them until they are written.
ROWS_A_DEAL = 1_000_000
#: Points of a cell whose pairs are added up, about: cells are wider than the reach where they would hold fewer.
POINTS_A_CELL = 500
#: Separations that are worked out at a time, about.
TILE = 1 << 14


@dataclass
class Plan:
    """How cells are dealt: partitions, the blocks of dense cells, the pairs expected and the tasks to deal them (0: as the points come)."""

    partitions: int
    pairs: float
    blocks: dict[tuple[int, int, int], int] = field(default_factory=dict)
    dealers: int = 0


def _grid(box: Sides | None, reach: tuple[float, float, float]) -> list[int | None]:
    """Cells of each axis; one where fewer than three fit, None without a box."""
    counts = [max(int(side / r), 1) for side, r in zip(three(box), reach, strict=True)] if box else [None] * 3
    return [(n if n >= 3 else 1) if n else None for n in counts]


def _cell(axis: int, box: Sides | None, reach: tuple[float, float, float], counts: list[int | None]) -> Column:
    x, n = F.col(AXES[axis]), counts[axis]
    if n is None:
        return F.floor(x / reach[axis])
    side = float(three(box)[axis])
    return F.least(F.floor(F.pmod(x, F.lit(side)) * (n / side)), F.lit(n - 1))


def _offsets(counts: list[int | None], half: bool) -> list[tuple[int, int, int]]:
    """Steps to neighbour cells; with half, one of each two opposite ones and the cell itself."""
    steps = list(itertools.product(*[(0,) if n == 1 else (-1, 0, 1) for n in counts]))
    return [s for s in steps if s >= (0, 0, 0)] if half else steps


def _histogram(df: DataFrame, cells: list[Column]) -> tuple[Counter, int]:
    """Sampled numbers of points by cell, scaled to the whole, and the number of points."""
    n = df.count()
    rate = max(n // SAMPLE, 1)
    seen = df.where(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0) if rate > 1 else df
    # The sample bounds the cells: at most about SAMPLE rows.
    found = seen.select(*[c.alias(name) for c, name in zip(cells, CELLS, strict=True)]).groupBy(*CELLS).count().collect()
    return Counter({(r["c0"], r["c1"], r["c2"]): r["count"] * rate for r in found}), n


def plan_pairs(a: DataFrame, b: DataFrame, box: Sides | None, reach: tuple[float, float, float], half: bool = False, summed: bool = False) -> Plan:
    """Partitions and blocks for a join of neighbour cells; blocks are named by the left side's cell. With summed, of few large blocks, in partitions of bounded rows."""
    a_task, cuts = (PAIRS_A_SUM, BLOCKS_A_SUM) if summed else (PAIRS_A_TASK, BLOCKS_A_TASK)
    counts = _grid(box, reach)
    cells = [_cell(i, box, reach, counts) for i in range(3)]
    left, n = _histogram(a, cells)
    right, _ = (left, n) if b is a else _histogram(b, cells)
    steps, near = _offsets(counts, half), {}
    for at in left:
        near[at] = sum(right[tuple((x + s) % k if k else x + s for x, s, k in zip(at, step, counts, strict=True))] for step in steps)
    work = {at: m * near[at] for at, m in left.items()}
    total = float(sum(work.values()))
    least = int(a.sparkSession.sparkContext.defaultParallelism)
    partitions = min(max(math.ceil(total / a_task), least), MOST_PARTITIONS)
    share = max(total / (partitions * cuts), 1.0)
    blocks = {at: math.ceil(math.sqrt(w / share)) for at, w in work.items() if w > share}
    dealers = 0
    if summed:
        # Both sides once, and once more for each further part of a dense cell.
        rows = sum(left.values()) + len(steps) * sum(right.values()) + sum((left[at] + near[at]) * (n - 1) for at, n in blocks.items())
        partitions = min(max(math.ceil(rows / ROWS_A_SUM), partitions), MOST_PARTITIONS)
        dealers = min(max(math.ceil(rows / ROWS_A_DEAL), least), MOST_PARTITIONS) if rows > ROWS_A_DEAL else 0
    return Plan(partitions, total, blocks, dealers)


def _dealt(a: DataFrame, b: DataFrame, keep_a: list[str], keep_b: list[str], box: Sides | None, reach: tuple[float, float, float], half: bool, summed: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the cell and block that they meet in, dealt to partitions by it, and the names of these columns."""
    counts, plan = _grid(box, reach), plan_pairs(a, b, box, reach, half, summed)
    cells = [_cell(i, box, reach, counts).alias(name) for i, name in enumerate(CELLS)]
    if plan.dealers:
        # A point becomes many rows, so few tasks that read many points would hold too many.
        a, b = (d.repartition(plan.dealers, "id") for d in (a, b))
    left = a.select(F.col("id").alias("id1"), *[F.col(c).alias(f"{c}1") for c in (*AXES, *keep_a)], *cells)
    right = b.select(F.col("id").alias("id2"), *[F.col(c).alias(f"{c}2") for c in (*AXES, *keep_b)], *cells)
    steps = _offsets(counts, half)
    # A point is sent to the cells of which its own is a neighbour.
    near = F.array(*[F.struct(*[(F.pmod(F.col(c) - s, F.lit(n)) if n else F.col(c) - s).alias(c) for c, s, n in zip(CELLS, step, counts, strict=True)], F.lit(step == (0, 0, 0)).alias("own")) for step in steps])
    right = right.withColumn("to", F.explode(near)).drop(*CELLS).select("*", "to.*").drop("to")
    keys = list(CELLS)
    if plan.blocks:
        # At most BLOCKS_A_TASK cells for each partition are dense.
        dense = F.broadcast(a.sparkSession.createDataFrame([(*map(int, at), n) for at, n in plan.blocks.items()], "c0 long, c1 long, c2 long, _b int"))
        sides = []
        for df, name, own, other in ((left, "id1", "_i", "_j"), (right, "id2", "_j", "_i")):
            df = df.join(dense, CELLS, "left").withColumn("_b", F.coalesce("_b", F.lit(1)))
            sides.append(df.withColumn(own, F.pmod(F.xxhash64(name), F.col("_b")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).drop("_b"))
        left, right = sides
        keys += ["_i", "_j"]
    return left.repartition(plan.partitions, *keys), right.repartition(plan.partitions, *keys), keys


def separations(a: DataFrame, b: DataFrame, radius: float, box: Sides | None = None, keep_a: list[str] = (), keep_b: list[str] = (), reach: tuple[float, float, float] | None = None, half: bool = False) -> DataFrame:
    """Ordered pairs of a and b whose cells are neighbours: id1, id2, dx, dy, dz and the kept columns, suffixed 1 and 2.

    With a box, separations are the nearest images. Cells are at least `reach` wide (by default the
    radius on each axis), so every pair within reach is found once; where fewer than three cells fit
    in the box, that axis has a single cell. Filter by distance afterwards; self pairs are included.
    With half, a and b are the same points and of each two ordered pairs one comes, in either order,
    without self pairs; only half of the neighbour cells is visited.
    """
    left, right, keys = _dealt(a, b, keep_a, keep_b, box, tuple(reach or (radius,) * 3), half)
    pairs = left.join(right, keys)
    if half:
        pairs = pairs.where(~F.col("own") | (F.col("id1") < F.col("id2")))
    gap = [F.col(f"{c}1") - F.col(f"{c}2") for c in AXES]
    if box is not None:
        gap = [d - side * F.rint(d / side) for d, side in zip(gap, three(box), strict=True)]
    return pairs.select("id1", "id2", *[g.alias(f"d{c}") for g, c in zip(gap, AXES, strict=True)], *[f"{c}1" for c in keep_a], *[f"{c}2" for c in keep_b])


def radius_pairs(a: DataFrame, b: DataFrame, radius: float, box: Sides | None = None, keep_a: list[str] = (), keep_b: list[str] = (), half: bool = False) -> DataFrame:
    """Pairs with separation s <= radius: id1, id2, s, dx, dy, dz."""
    p = separations(a, b, radius, box, keep_a, keep_b, half=half)
    s2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    return p.where(s2 <= radius * radius).withColumn("s", F.sqrt(s2))


@dataclass
class Tile:
    """Some points of a block against those that may be near them: places in both sides and a table of separations for each axis."""

    rows: np.ndarray
    near: np.ndarray
    gaps: list[np.ndarray]

    def pairs(self, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in both sides, and in the flat tables, of the pairs that a table of booleans marks."""
        at = np.flatnonzero(within)
        i, j = np.divmod(at, within.shape[1])
        return self.rows[i], self.near[j], at

    def squared(self) -> np.ndarray:
        return sum_squares(self.gaps)


def sum_squares(tables: list[np.ndarray]) -> np.ndarray:
    """The sum of the tables' squares, from the first to the last."""
    total = tables[0] * tables[0]
    for t in tables[1:]:
        total += t * t
    return total


@dataclass
class Patch:
    """The points of a small box and those that may be near them, each with one image (moved by `moved`, None for nowhere) for all of the box."""

    rows: np.ndarray
    near: np.ndarray
    own: np.ndarray
    there: np.ndarray
    moved: list[np.ndarray | None]

    def images(self) -> np.ndarray:
        return np.stack([c if m is None else c + m for c, m in zip(self.there, self.moved, strict=True)])

    def squared(self, part: slice, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
        """Squared separations of the box's points and a part of those near them; two tables to write to."""
        for a in range(3):
            d = np.subtract(self.own[:, a, None], self.there[a, part], out=spare if a else out)
            if self.moved[a] is not None:
                d -= self.moved[a][part]
            d *= d
            if a:
                out += d
        return out


def tiles(x: np.ndarray, y: np.ndarray, reach: tuple[float, ...], box: Sides | None, groups: tuple[tuple[int, ...], ...] = ((0, 1, 2),), patches: int = 0) -> Iterator[Tile | Patch]:
    """Tiles that hold every pair of x and y within reach, by ellipsoids over each group of axes, and few others.

    With patches, boxes have about so many points, and one whose points see one image of each point comes as one patch and not as tiles.

    The left side is cut into boxes; the points of the right side that are too far from a box are left out. No table has more
    than about TILE places or one row. A box that is small against the periodic side has one image of each right point.
    """
    if not len(x) or not len(y):
        return
    low, high = x.min(axis=0), x.max(axis=0)
    cuts = int(min(max(round((len(x) / (patches or 24)) ** (1 / 3)), 1), 8))
    place = np.minimum(((x - low) / np.where(high > low, high - low, 1.0) * cuts).astype(int), cuts - 1)
    code = (place[:, 0] * cuts + place[:, 1]) * cuts + place[:, 2]
    order = np.argsort(code, kind="stable")
    sides, columns = three(box) if box is not None else (None,) * 3, np.ascontiguousarray(y.T)
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        own = x[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        middle, wide = (low + high) / 2, (high - low) / 2
        beyond, shift, whole = [0.0] * 3, [None] * 3, [False] * 3
        for a, side in enumerate(sides):
            d = middle[a] - columns[a]
            if side is not None:
                # Where the nearest image may differ within the box, each pair has its own.
                whole[a] = (reach[a] + wide[a]) * (1 + 1e-9) >= side / 2
                shift[a] = side * np.rint(d / side)
                d -= shift[a]
            if not whole[a]:
                d = np.maximum(np.abs(d, out=d) - wide[a], 0.0)
                d /= reach[a]
                beyond[a] = d * d
        # A little more than the reach, for rounding.
        close = np.ones(len(y), bool)
        for g in groups:
            close &= sum(beyond[a] for a in g) <= 1 + 1e-6
        near = np.flatnonzero(close)
        if not len(near):
            continue
        there, step = columns[:, near], max(TILE // len(near), 1)
        moved = [None if whole[a] or shift[a] is None or not (m := shift[a][near]).any() else m for a in range(3)]
        if patches and not any(whole):
            # Nearest first, so that a part of them has a narrow range of separations.
            way = [middle[a] - there[a] - (0.0 if moved[a] is None else moved[a]) for a in range(3)]
            order_near = np.argsort(sum_squares(way))
            yield Patch(rows, near[order_near], own, there[:, order_near], [m if m is None else m[order_near] for m in moved])
            continue
        for i in range(0, len(rows), step):
            gaps = []
            for a, side in enumerate(sides):
                d = own[i : i + step, a, None] - there[a]
                if whole[a]:
                    d -= side * np.rint(d / side)
                elif moved[a] is not None:
                    d -= moved[a]
                gaps.append(d)
            yield Tile(rows[i : i + step], near, gaps)


def finite(df: DataFrame) -> DataFrame:
    """The points that have a place: others are near none."""
    return df.where(sum((F.when(F.abs(F.col(c)) < float("inf"), 0).otherwise(1) for c in AXES), F.lit(0)) == 0)


def _wide(sides: list[DataFrame], reach: tuple[float, float, float]) -> tuple[float, float, float]:
    """The reach, or the side of a cell with about POINTS_A_CELL points where that is more."""
    seen = [d.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{c}") for c in AXES for k, f in (("lo", F.min), ("hi", F.max))]).first() for d in sides]
    seen = [s for s in seen if s["n"]]
    if not seen:
        return reach
    # The larger table; at least one reach a side, so that flat tables have a volume.
    room = math.prod(max(max(s[f"hi{c}"] for s in seen) - min(s[f"lo{c}"] for s in seen), r) for c, r in zip(AXES, reach, strict=True))
    side = (room / max(s["n"] for s in seen) * POINTS_A_CELL) ** (1 / 3)
    return tuple(max(r, side) for r in reach)


def block_sums(a: DataFrame, b: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame, Iterator[Tile]], pd.DataFrame], schema: str, reach: tuple[float, float, float], box: Sides | None = None, keep_a: list[str] = (), keep_b: list[str] = (), half: bool = False, groups: tuple[tuple[int, ...], ...] = ((0, 1, 2),), patches: int = 0) -> DataFrame:
    """What run() makes of each block of two neighbourhoods, given both sides and the tiles with all pairs within reach.

    A block is a cell, or a part of a dense one, with the points of its neighbour cells (half of them with half; then a pair
    within a cell comes twice, marked `own` on the right side). Pairs are never rows: they are added up where they are made.
    """
    sides = [finite(d) for d in ((a,) if b is a else (a, b))]
    left, right, keys = _dealt(sides[0], sides[-1], keep_a, keep_b, box, _wide(sides, reach), half, True)

    def call(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        at = [d[[f"{c}{k}" for c in AXES]].to_numpy(float) for k, d in ((1, x), (2, y))]
        return run(x, y, tiles(*at, reach, box, groups, patches))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(call, schema)


def smallest(a: DataFrame, b: DataFrame, k: int, radius: float, box: Sides) -> DataFrame:
    """(id, r array<double>): the distances of at most k nearest points of b within the radius, in rising order.

    A cell's block and its 27 neighbours meet in one task, which keeps k distances for each point; those of a dense
    cell's blocks are merged after a shuffle, so it moves k numbers for a block and no pairs.
    """

    def run(x: pd.DataFrame, y: pd.DataFrame, tiles: Iterator[Tile]) -> pd.DataFrame:
        ids, who, out = x["id1"].to_numpy(), [], []
        for t in tiles:
            d = np.sqrt(t.squared())
            d = np.sort(np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d, axis=1)
            who.append(ids[t.rows])
            out += [row[row <= radius] for row in d]
        return pd.DataFrame({"id": np.concatenate(who) if who else ids[:0], "near": pd.Series(out, dtype=object)})

    found = block_sums(a, b, run, "id long, near array<double>", (radius,) * 3, box).where(F.size("near") > 0)
    return found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("r"))


def nearest(a: DataFrame, k: int, box: Sides, first_radius: float | None = None) -> DataFrame:
    """The distance to the k-th nearest point in a periodic box, itself included: (id, r). Needs at least k points.

    A point is settled when its k-th neighbour is within the radius searched; the others go on with twice the
    radius. Rounds are written, so that none is computed twice.
    """
    n, scratch, sides = a.count(), Scratch(a.sparkSession), three(box)
    if n < k:
        raise ValueError(f"{n} points have no {k}-th neighbour")
    a = scratch.keep(a.select("id", *AXES), "points")
    radius = first_radius or (math.prod(sides) * 2.0 * k / (4 / 3 * math.pi * n)) ** (1 / 3)
    left, out = a, None
    while True:
        whole = radius >= math.sqrt(sum(s * s for s in sides)) / 2
        found = scratch.keep(smallest(left, a, k, radius, box).where(F.size("r") >= k).select("id", F.col("r")[k - 1].alias("r")), f"round-{radius:g}")
        out = found if out is None else out.unionByName(found)
        left = scratch.keep(left.join(found, "id", "left_anti"), f"left-{radius:g}")
        if whole or left.isEmpty():
            return out
        radius *= 2
