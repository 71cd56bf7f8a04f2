"""Rectangles and geometry constraints as Column expressions.

A rectangle is four flat columns ``lat_min, lat_max, lon_min, lon_max``; intervals are closed, so that
touching counts as overlap, and nothing wraps around the antimeridian.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rect:
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float

    def overlaps(self, other: Rect) -> bool:
        return self.lat_min <= other.lat_max and self.lat_max >= other.lat_min and self.lon_min <= other.lon_max and self.lon_max >= other.lon_min

    def intersection(self, other: Rect) -> Rect:
        return Rect(max(self.lat_min, other.lat_min), min(self.lat_max, other.lat_max), max(self.lon_min, other.lon_min), min(self.lon_max, other.lon_max))

    def enlarged(self, other: Rect) -> Rect:
        """Smallest rectangle around both."""
        return Rect(min(self.lat_min, other.lat_min), max(self.lat_max, other.lat_max), min(self.lon_min, other.lon_min), max(self.lon_max, other.lon_max))

    def overlap_column(self, prefix: str = "") -> Column:
        """Whether a row's rectangle overlaps this one; bare comparisons, which reach the parquet scan."""
        c = lambda name: F.col(prefix + name)
        return (c("lat_min") <= F.lit(self.lat_max)) & (c("lat_max") >= F.lit(self.lat_min)) & (c("lon_min") <= F.lit(self.lon_max)) & (c("lon_max") >= F.lit(self.lon_min))


SIDES = tuple(f.name for f in fields(Rect))


def overlap(a: str, b: str) -> Column:
    """Whether two rectangles of one row overlap, given their column prefixes."""
    l, r = (lambda name, p=p: F.col(p + name) for p in (a, b))
    return (l("lat_min") <= r("lat_max")) & (l("lat_max") >= r("lat_min")) & (l("lon_min") <= r("lon_max")) & (l("lon_max") >= r("lon_min"))


class GeoConstraint:
    """A union of rectangles; none at all matches nothing.

    ``a + b`` lists the rectangles of both, ``a / b`` the rectangles in which one of a and one of b
    meet. The latter is stricter than overlapping with both: a row has to reach into the meeting place.
    """

    def __init__(self, *rects: Rect):
        self.rects = tuple(rects)

    def __add__(self, other: GeoConstraint) -> GeoConstraint:
        return GeoConstraint(*self.rects, *other.rects)

    def __truediv__(self, other: GeoConstraint) -> GeoConstraint:
        return GeoConstraint(*(a.intersection(b) for a in self.rects for b in other.rects if a.overlaps(b)))

    def empty(self) -> bool:
        return not self.rects

    def intersects(self, rect: Rect) -> bool:
        return any(r.overlaps(rect) for r in self.rects)

    def column(self, prefix: str = "") -> Column:
        return reduce(Column.__or__, (r.overlap_column(prefix) for r in self.rects), F.lit(False)) if self.rects else F.lit(False)


def enclosing(prefix: str = "") -> list[Column]:
    """Aggregates of the smallest rectangle around a group's."""
    return [(F.min if s.endswith("min") else F.max)(prefix + s).alias(s) for s in SIDES]


def area(prefix: str = "") -> Column:
    c = lambda name: F.col(prefix + name)
    return (c("lat_max") - c("lat_min")) * (c("lon_max") - c("lon_min"))


def margin(prefix: str = "") -> Column:
    """Perimeter."""
    c = lambda name: F.col(prefix + name)
    return 2 * ((c("lat_max") - c("lat_min")) + (c("lon_max") - c("lon_min")))


def midpoint(prefix: str = "") -> tuple[Column, Column]:
    c = lambda name: F.col(prefix + name)
    return (c("lat_min") + c("lat_max")) / 2, (c("lon_min") + c("lon_max")) / 2


def centre_distance(a: str, b: str) -> Column:
    """Euclidean distance of the midpoints."""
    (y, x), (v, u) = midpoint(a), midpoint(b)
    return F.hypot(y - v, x - u)


def morton(prefix: str = "", extent: Rect = Rect(-9000, 9000, -18000, 18000), bits: int = 16) -> Column:
    """Interleaved bits of the midpoint's place in ``extent``: rows near each other in it are near each other on the map."""
    low, parts = (extent.lat_min, extent.lon_min), []
    span = (extent.lat_max - low[0] or 1.0, extent.lon_max - low[1] or 1.0)
    for axis, mid in enumerate(midpoint(prefix)):
        cell = F.floor((mid - low[axis]) / F.lit(float(span[axis])) * (1 << bits)).cast("long")
        x = F.least(F.greatest(cell, F.lit(0)), F.lit((1 << bits) - 1))
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        parts.append(F.shiftleft(x, 1 - axis))
    return parts[0].bitwiseOR(parts[1])
