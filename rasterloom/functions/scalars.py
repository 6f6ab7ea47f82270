"""Interpolation, clamping, projections and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEGREE_M = 111320.0
#: Words that names are compared without: fixed values, a parameter of name_tokens.
STOP = ("the", "at", "and", "of", "de", "la", "le", "el", "no")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def smoothstep(low: float, high: float, x: Column) -> Column:
    """Hermite easing; a step where the edges meet."""
    if high == low:
        return F.when(x < low, 0.0).otherwise(1.0)
    t = clamp((x - low) / (high - low))
    return t * t * (3.0 - 2.0 * t)


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear lookup, held at the ends."""
    out = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= knots[0][0], knots[0][1]).otherwise(out)


def from_unit(u: Column, low: float, high: float, log: bool = False, integer: bool = False) -> Column:
    """A unit draw on a knob's range."""
    v = low * F.pow(F.lit(high / low), u) if log else low + u * (high - low)
    return F.round(v) if integer else v


def to_unit(v: Column, low: float, high: float, log: bool = False) -> Column:
    return F.log(v / low) / F.log(F.lit(high / low)) if log else (v - low) / (high - low)


def local_metres(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Equirectangular metres east and north of an origin."""
    return (lon - lon0) * DEGREE_M * F.cos(F.radians(F.lit(lat0))), (lat - lat0) * DEGREE_M


def tile_fraction(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-mercator tile coordinates with fractions."""
    n = float(1 << zoom)
    phi = F.radians(lat)
    return (lon + 180.0) / 360.0 * n, (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / F.pi()) / 2.0 * n


def name_tokens(name: Column, stop: tuple[str, ...] = STOP) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.array_except(words, F.array(*map(F.lit, (*stop, "")))))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
