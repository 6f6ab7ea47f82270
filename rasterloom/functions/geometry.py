"""Elevation codes, stream widths, shading and plane geometry as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ("lowland", "rolling", "mountain")


def terrarium(red: Column, green: Column, blue: Column) -> Column:
    """Metres of a terrarium-coded colour."""
    return red * 256 + green + blue / 256.0 - 32768


def banded(relief: Column, low: float, high: float) -> Column:
    return F.when(relief < low, BANDS[0]).when(relief < high, BANDS[1]).otherwise(BANDS[2])


def stream_width(runoff: Column, area: Column) -> Column:
    """Metres, by the square root of the flow: 2.5 to 90."""
    return F.least(F.lit(90.0), F.greatest(F.lit(2.5), 0.005 * F.sqrt(runoff * area)))


def stream_class(width: Column) -> Column:
    return F.when(width < 4, "brook").when(width < 8, "creek").otherwise("river")


def hillshade(gx: Column, gy: Column, azimuth: float, altitude: float) -> Column:
    """Light on a slope from a compass direction and height, in degrees; 0 in shadow."""
    a, h = math.radians(azimuth), math.radians(altitude)
    light = math.sin(h) + math.cos(h) * (math.sin(a) * -gx + math.cos(a) * -gy)
    return F.greatest(F.lit(0.0), light / F.sqrt(1 + gx * gx + gy * gy))


def inside_polygon(x: Column, y: Column, corners) -> Column:
    """Even-odd rule; level edges never count."""
    crossings = []
    for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y0 != y1:
            spans = (F.lit(y0) > y) != (F.lit(y1) > y)
            crossings.append(F.when(spans & (x < x0 + (y - y0) / (y1 - y0) * (x1 - x0)), 1).otherwise(0))
    return reduce(lambda a, b: a + b, crossings) % 2 == 1


def dogleg_turn(first: Column, second: Column, straight: Column) -> Column:
    """The turn in degrees of two legs whose ends lie so far apart; null if they can't."""
    bend = F.degrees(F.acos((first * first + second * second - straight * straight) / (2 * first * second)))
    return F.when((straight < first + second) & (straight > F.abs(first - second)), 180 - bend)


def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment, which may be a point itself."""
    length2 = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
    u = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length2))).otherwise(0.0)
    return F.sqrt(F.pow(px - (ax + u * (bx - ax)), 2) + F.pow(py - (ay + u * (by - ay)), 2))
