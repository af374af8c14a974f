"""Boxes (x0, y0, x1, y1; y upwards) as arithmetic over four columns each."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.x1 - b.x0) * F.greatest(F.lit(0.0), b.y1 - b.y0)


def intersection(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    h = F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    return w * h


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def overlaps(a: Box, b: Box) -> Column:
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def containment(inner: Box, outer: Box) -> Column:
    """Share of the inner box inside the outer one."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def horizontal_overlap(a: Box, b: Box) -> Column:
    width = F.least(a.x1 - a.x0, b.x1 - b.x0)
    return F.when(width > 0, F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) / width).otherwise(0.0)


def gap(a: Box, b: Box) -> Column:
    """Euclidean distance of two boxes, 0 if they touch."""
    dx = F.greatest(F.lit(0.0), b.x0 - a.x1, a.x0 - b.x1)
    dy = F.greatest(F.lit(0.0), b.y0 - a.y1, a.y0 - b.y1)
    return F.sqrt(dx * dx + dy * dy)


def in_region(b: Box, region: Box) -> Column:
    """The centre lies inside, or half of the box at least does."""
    cx, cy = (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2
    inside = cx.between(region.x0, region.x1) & cy.between(region.y0, region.y1)
    return inside | (containment(b, region) >= 0.5)


def rotate(b: Box, degrees: Column, width: Column, height: Column) -> Box:
    """The box after its page turned clockwise by 0, 90, 180 or 270 degrees."""
    pick = lambda *v: F.when(degrees == 90, v[1]).when(degrees == 180, v[2]).when(degrees == 270, v[3]).otherwise(v[0])
    return Box(pick(b.x0, b.y0, width - b.x1, height - b.y1), pick(b.y0, width - b.x1, height - b.y1, b.x0), pick(b.x1, b.y1, width - b.x0, height - b.y0), pick(b.y1, width - b.x0, height - b.y0, b.x1))


def half_points(size: Column) -> Column:
    """Rounded to 0.5."""
    return F.round(size / 0.5) * 0.5
