"""Sides of boxes and grids: one number for a cube, or one for each axis."""

from __future__ import annotations

import math
from collections.abc import Sequence

Sides = float | Sequence[float]
Cells = int | Sequence[int]


def three(value) -> tuple:
    """One value for each axis."""
    if not isinstance(value, (int, float)) and len(value) != 3:
        raise ValueError(f"three sides are needed, not {len(value)}")
    return (value,) * 3 if isinstance(value, (int, float)) else tuple(value)


def volume(value: Sides) -> float:
    """The product of the sides; of a grid, the number of cells."""
    return math.prod(three(value))


def ratios(value: Sides) -> tuple[float, ...]:
    """Each axis' unit of wavenumber, 2 pi over the side, in that of the longest side; 1 on all axes of a cube."""
    sides = three(value)
    return tuple(max(sides) / s for s in sides)
