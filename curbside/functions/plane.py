"""Planar geometry on columns. Degrees are treated as a plane, without earth curvature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance, spelled with products so that it is bit-equal on every SQL engine."""
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def box_near(x: Column, y: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Distance from a point to the closest spot of a box. For a box that is one point, ``distance`` itself.

    Subtraction, product, sum and root round monotonically, so the value never exceeds the computed distance to any
    point inside the box.
    """
    dx = F.greatest(x0 - x, x - x1, F.lit(0.0))
    dy = F.greatest(y0 - y, y - y1, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def box_far(x: Column, y: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Distance from a point to the farthest spot of a box; never below the distance to any point inside it."""
    dx = F.greatest(F.abs(x - x0), F.abs(x1 - x))
    dy = F.greatest(F.abs(y - y0), F.abs(y1 - y))
    return F.sqrt(dx * dx + dy * dy)


def normalize_lon(lon: Column) -> Column:
    """Wrap a longitude into [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def is_finite(value: Column) -> Column:
    return F.abs(value) < F.lit(float("inf"))
