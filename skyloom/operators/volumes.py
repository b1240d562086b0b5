"""Sub-volumes: a periodic box cut into octree boxes of bounded numbers of points, with ghost margins.

A histogram of a bounded sample on the finest cells tells where to cut: a box of the octree is cut on while
it is thought to hold more than `most` points. Boxes are numbered along a space-filling curve (Morton
order), rows are dealt by ranges of that number, so that a task gets whole boxes that lie together. A box
sees the points around it through copies, at most 27 of a point, made before the shuffle.
"""

from __future__ import annotations

import itertools
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.box import Sides, three
from skyloom.operators.spatial import AXES, SAMPLE

#: The finest boxes are 2^-LEVELS of the box wide.
LEVELS = 8


def morton(cells: list[Column], bits: int) -> Column:
    """The bits of whole numbers in turns, those of the first one highest."""
    key = F.lit(0).cast("long")
    for b in range(bits):
        for i, c in enumerate(cells):
            bit = F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(bit, 3 * b + 2 - i))
    return key


@dataclass(frozen=True)
class Octree:
    """Boxes (level, place along the curve at that level) in the order of the curve, and the level of the finest cells."""

    levels: int
    boxes: tuple[tuple[int, int], ...]

    def bounds(self, sides: tuple[float, ...]) -> list[tuple[int, int, int, list[float], list[float]]]:
        """(number, level, place, lower corner, upper corner) of each box."""
        out = []
        for number, (level, place) in enumerate(self.boxes):
            cell = [sum(((place >> (3 * b + 2 - i)) & 1) << b for b in range(level)) for i in range(3)]
            out.append((number, level, place, [c * s / 2**level for c, s in zip(cell, sides, strict=True)], [(c + 1) * s / 2**level for c, s in zip(cell, sides, strict=True)]))
        return out


def _finest(at: list[Column], sides: tuple[float, ...], levels: int) -> Column:
    cells = [F.least(F.floor(x * (2**levels / s)), F.lit(2**levels - 1)) for x, s in zip(at, sides, strict=True)]
    return morton(cells, levels)


def cut(df: DataFrame, box: Sides, most: int, margin: float = 0.0) -> Octree:
    """Boxes that hold some points, at most about `most` each, and are no narrower than the margin."""
    sides = tuple(map(float, three(box)))
    levels = max((k for k in range(LEVELS + 1) if min(sides) / 2**k >= margin), default=-1)
    if levels < 0:
        raise ValueError("the margin is wider than the box")
    n = df.count()
    rate = max(n // SAMPLE, 1)
    seen = df.where(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0) if rate > 1 else df
    at = [F.pmod(F.col(a), F.lit(s)) for a, s in zip(AXES, sides, strict=True)]
    counts = [Counter() for _ in range(levels + 1)]
    # At most about SAMPLE cells.
    for r in seen.groupBy(_finest(at, sides, levels).alias("key")).count().collect():
        for level in range(levels + 1):
            counts[level][r["key"] >> (3 * (levels - level))] += r["count"] * rate
    boxes, open_ = [], [(0, 0)] if counts[0] else []
    while open_:
        level, place = open_.pop()
        if level == levels or counts[level][place] <= most:
            boxes.append((level, place))
        else:
            open_ += [(level + 1, p) for p in range(place * 8 + 7, place * 8 - 1, -1) if p in counts[level + 1]]
    if rate > 1:
        # Points that the sample has missed may lie in any box: none is left out.
        boxes = _filled(boxes)
    return Octree(levels, tuple(boxes))


def _filled(boxes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The boxes and their missing siblings, so that they fill the whole box, in the order of the curve."""
    inner = {(level - k, place >> (3 * k)) for level, place in boxes for k in range(1, level + 1)}
    held, out, open_ = set(boxes), [], [(0, 0)]
    while open_:
        level, place = open_.pop()
        if (level, place) in held or (level, place) not in inner:
            out.append((level, place))
        else:
            open_ += [(level + 1, p) for p in range(place * 8 + 7, place * 8 - 1, -1)]
    return out


def sub_volumes(df: DataFrame, box: Sides, most: int, margin: float = 0.0, keep: list[str] = (), tree: Octree | None = None) -> DataFrame:
    """volume, ghost, id, x, y, z, lo and hi (corners of the volume) and the kept columns: each point in its volume, and as a ghost in those within the margin.

    A volume sees the points with lo - margin <= x < hi + margin on all axes; ghosts beyond the box's edge are
    at the place of that image. Positions are brought into the box; rows are dealt by ranges of the volumes.
    """
    spark, sides, tree = df.sparkSession, tuple(map(float, three(box))), tree or cut(df, box, most, margin)
    bounds = spark.createDataFrame(tree.bounds(sides), "volume int, level int, place long, lo array<double>, hi array<double>")
    at = df.select("id", *[F.pmod(F.col(a), F.lit(s)).alias(a) for a, s in zip(AXES, sides, strict=True)], *keep)
    steps = list(itertools.product(*[(0.0, -margin, margin) if margin else (0.0,)] * 3))

    found = at.withColumn("step", F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps])))
    moved = [F.col(a) + F.col("step")[i] for i, a in enumerate(AXES)]
    found = found.withColumn("image", F.array(*[F.when(m < 0, s).when(m >= s, -s).otherwise(0.0) for m, s in zip(moved, sides, strict=True)]))
    found = found.withColumn("key", _finest([m + F.col("image")[i] for i, m in enumerate(moved)], sides, tree.levels))
    levels = sorted({level for level, _ in tree.boxes}) or [0]
    found = found.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("place", F.expr(f"shiftright(key, 3 * ({tree.levels} - level))")).drop("key")
    # Boxes come from the bounded sample, so their number is bounded too.
    found = found.join(F.broadcast(bounds), ["level", "place"])
    first = F.lit(True)
    for i, a in enumerate(AXES):
        x, o, lo, hi = F.col(a) + F.col("image")[i], F.col("step")[i], F.col("lo")[i], F.col("hi")[i]
        within = lambda p, lo=lo, hi=hi: (p >= lo) & (p < hi)
        # Of the steps that reach one box along an axis the first one counts: none, down, up.
        first = first & ((o == 0) | (o < 0) & ~within(x) | (o > 0) & ~within(x) & ~within(x - margin))
    ghost = F.exists("step", lambda o: o != 0)
    out = found.where(first).select("volume", ghost.alias("ghost"), "id", *[(F.col(a) + F.col("image")[i]).alias(a) for i, a in enumerate(AXES)], "lo", "hi", *keep)
    return out.repartitionByRange("volume")
