"""Positions, distances and grid cells as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per light-year used when loading a map, and the rounder one used when cutting
# a fixture out of a dataset. They differ on purpose and each caller keeps its own.
METRES_PER_LIGHT_YEAR = 9.4607304725808e15
METRES_PER_LIGHT_YEAR_FIXTURE = 9.461e15


def light_years(metres: Column, metres_per_ly: float = METRES_PER_LIGHT_YEAR) -> Column:
    """Metres to light-years."""
    return metres / F.lit(metres_per_ly)


def is_finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite (never null itself)."""
    return F.coalesce(
        ~F.isnan(value) & (F.abs(value) < F.lit(math.inf)),
        F.lit(False),
    )


def only_if_placed(value: Column, x: Column, y: Column, z: Column) -> Column:
    """``value`` when all three coordinates are usable, else null (a half-known position is none)."""
    return F.when(is_finite(x) & is_finite(y) & is_finite(z), value)


def distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Euclidean distance; null when any coordinate is null."""
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def cell(value: Column, size: Column | float) -> Column:
    """Index of the grid cell that holds ``value``."""
    size = size if isinstance(size, Column) else F.lit(float(size))
    return F.floor(value / size).cast("long")


def room_in_block(value: Column, size: float) -> Column:
    """Along one axis, the distance from ``value`` to the nearer end of its cell's 3-cell run."""
    offset = value - F.floor(value / F.lit(size)) * F.lit(size)
    return F.lit(size) + F.least(offset, F.lit(size) - offset)
