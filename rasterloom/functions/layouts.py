"""Lines of play, their legs and bends, and the relief estimate of a world's knobs, as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import to_segment
from .noise import bind, times, u32
from .scalars import clamp

#: Metres a degree of latitude of the layout's survey frame, which differ from those of local_metres: fixed values.
EAST_M, NORTH_M = 111320.0, 110540.0
#: Calibration tables: fixed values. Period and gain axes, relief of a unit field by both; strengths with their
#: relief multiplier and skewness; erosion intensity and period axes, relief kept by both.
PERIODS = (250.0, 500.0, 800.0, 1200.0, 1600.0, 2000.0, 2400.0)
GAINS = (0.50, 0.57, 0.64, 0.71, 0.78)
RELIEF = (
    (0.8010, 0.7757, 0.7556, 0.7403, 0.7297),
    (0.7351, 0.7003, 0.6716, 0.6494, 0.6339),
    (0.6592, 0.6181, 0.5847, 0.5596, 0.5436),
    (0.6540, 0.6134, 0.5780, 0.5471, 0.5256),
    (0.5922, 0.5662, 0.5418, 0.5209, 0.5046),
    (0.5279, 0.5097, 0.4954, 0.4848, 0.4778),
    (0.4924, 0.4778, 0.4657, 0.4551, 0.4470),
)
STRENGTHS = (1.00, 1.60, 2.50, 4.00, 6.50, 10.00)
STRENGTH_RELIEF = (1.0000, 1.0322, 0.8551, 0.5031, 0.1757, 0.0382)
STRENGTH_SKEW = (0.0279, 0.2351, 0.5379, 1.0316, 1.8498, 3.0017)
INTENSITIES = (0.5, 1.0, 2.0, 3.0, 4.5, 6.0)
EROSION_PERIODS = (800.0, 1400.0, 2000.0)
KEPT = ((0.9491, 0.9783, 0.9874), (0.9270, 0.9642, 0.9760), (0.8758, 0.9325, 0.9495), (0.8345, 0.9059, 0.9283), (0.7940, 0.8785, 0.9058), (0.7706, 0.8630, 0.8929))
#: What a metric's first word is called in descriptions: fixed values.
ALIASES = {"relief": "relief", "elev": "elev", "slope": "slope", "frac": "flat", "spectral": "beta", "hurst": "beta", "highfreq": "high-freq", "variogram": "variogram", "rms": "rough", "mean": "curv", "profile": "curv", "plan": "curv", "laplacian": "sharp", "local": "relief", "heterogeneity": "heterogeneity", "drainage": "drainage", "valley": "valley", "concavity": "concavity", "anisotropy": "anisotropy"}


# Lookups.
def table1(x: Column, axis: tuple[float, ...], values: tuple[float, ...]) -> Column:
    """Linear lookup, held at the ends of the axis."""
    parts = list(zip(zip(axis, values, strict=True), zip(axis[1:], values[1:], strict=True), strict=False))
    out = F.lit(values[-1])
    for (x0, v0), (x1, v1) in reversed(parts):
        out = F.when(x <= x1, v0 + (F.greatest(x, F.lit(axis[0])) - x0) * ((v1 - v0) / (x1 - x0))).otherwise(out)
    return out


def table2(x: Column, y: Column, rows: tuple[float, ...], columns: tuple[float, ...], values: tuple[tuple[float, ...], ...]) -> Column:
    """Lookup linear along the columns, then the rows, held at the ends of both axes."""
    along = [table1(y, columns, v) for v in values]
    out = along[-1]
    for i in reversed(range(len(rows) - 1)):
        part = (F.greatest(x, F.lit(rows[0])) - rows[i]) / (rows[i + 1] - rows[i])
        out = F.when(x <= rows[i + 1], along[i] + (along[i + 1] - along[i]) * part).otherwise(out)
    return out


def strength(power: Column) -> Column:
    return F.when(power >= 1, power).otherwise(1 / F.greatest(power, F.lit(1e-6)))


def relief_estimate(amplitude: Column, period: Column, gain: Column, power: Column, intensity: Column) -> Column:
    """Relief that a world's knobs give before it is made."""
    field = F.greatest(table2(period, gain, PERIODS, GAINS, RELIEF), F.lit(0.05))
    shape = F.greatest(table1(strength(power), STRENGTHS, STRENGTH_RELIEF), F.lit(0.05))
    kept = F.greatest(table2(intensity, period, INTENSITIES, EROSION_PERIODS, KEPT), F.lit(0.1))
    return F.greatest(amplitude * field * shape * kept, F.lit(0.0))


def skew_estimate(power: Column) -> Column:
    size = table1(strength(power), STRENGTHS, STRENGTH_SKEW)
    return F.when(power >= 1, size).otherwise(-size)


def octaves(period: Column, finest: float = 30.0) -> Column:
    """Octaves that resolve the finest feature, 3 to 7."""
    return F.least(F.lit(7), F.greatest(F.lit(3), F.ceil(F.log(F.greatest(period / finest, F.lit(2.0))) / math.log(2.0)).cast("int") + 1))


def eased_knots(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Lookup eased between knots, so that it has no corners; held at the ends."""
    out = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        u = (x - x0) / (x1 - x0)
        out = F.when(x <= x1, y0 + (y1 - y0) * (u * u * (3 - 2 * u))).otherwise(out)
    return F.when(x <= knots[0][0], knots[0][1]).otherwise(out)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def soft_clamp(x: Column, limit: Column) -> Column:
    """x well below a limit, the limit well above it; x itself without a positive limit."""
    e = F.exp(2 * clamp(x / _positive(limit), -20.0, 20.0))
    return F.when(limit > 0, limit * (e - 1) / (e + 1)).otherwise(x)


def hash_share(x: Column) -> Column:
    """An integer's hash in [0, 1), by 32-bit mixing (fixed multipliers and shifts)."""
    fold = lambda h, k: h.bitwiseXOR(F.shiftright(h, k))
    h = fold(u32(x.cast("long")).bitwiseXOR(F.lit(0x9E3779B9)), 16)
    return fold(times(fold(times(h, 0x7FEB352D), 15), 0x846CA68B), 16) / F.lit(4294967296.0)


def names_metric(text: Column, metric: Column) -> Column:
    """Whether a description names a metric: whole, by its first word, or by what that is called."""
    low, first = F.lower(text), F.substring_index(metric, "_", 1)
    alias = F.element_at(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair)), first)
    return low.contains(metric) | low.contains(first) | F.coalesce(low.contains(alias), F.lit(False))


def survey_metres(lat: Column, lon: Column, south: Column, north: Column, west: Column) -> tuple[Column, Column]:
    """Metres east of the west edge and south of the north edge, by the frame's middle latitude."""
    return (lon - west) * EAST_M * F.cos(F.radians((south + north) / 2)), (north - lat) * NORTH_M


# Legs and bends.
def _positive(x: Column) -> Column:
    """x where it can divide, else null."""
    return F.when(x > 0, x)


def cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a triangle."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_meet(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """Whether segments (ax, ay, bx, by) cross, touch or overlap."""
    sides = (cross(*q, *p[:2]), cross(*q, *p[2:]), cross(*p, *q[:2]), cross(*p, *q[2:]))
    across = (sides[0] * sides[1] < 0) & (sides[2] * sides[3] < 0)

    def on(s: tuple[Column, ...], x: Column, y: Column, side: Column) -> Column:
        return (side == 0) & x.between(F.least(s[0], s[2]), F.greatest(s[0], s[2])) & y.between(F.least(s[1], s[3]), F.greatest(s[1], s[3]))

    touch = (on(q, *p[:2], sides[0]), on(q, *p[2:], sides[1]), on(p, *q[:2], sides[2]), on(p, *q[2:], sides[3]))
    return reduce(lambda a, b: a | b, touch, across)


def segment_distance(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """Least distance of two segments, 0 if they meet."""
    return F.when(segments_meet(p, q), 0.0).otherwise(F.least(to_segment(*p[:2], *q), to_segment(*p[2:], *q), to_segment(*q[:2], *p), to_segment(*q[2:], *p)))


def bend(ax: Column, ay: Column, bx: Column, by: Column, length: Column, share: Column, side: Column, most: float = 55.0) -> Column:
    """The vertex (x, y) and turn in degrees of a line from a to b of this length whose first leg has this share; null if it turns too much."""
    def found(v: Column) -> Column:
        d = _positive(F.sqrt(F.pow(v["bx"] - v["ax"], 2) + F.pow(v["by"] - v["ay"], 2)))
        return bind(F.struct(v["ax"].alias("ax"), v["ay"].alias("ay"), d.alias("d"), ((v["bx"] - v["ax"]) / d).alias("ux"), ((v["by"] - v["ay"]) / d).alias("uy"), (share * v["length"]).alias("first"), ((1 - share) * v["length"]).alias("second"), v["length"].alias("length")), vertex)

    def vertex(v: Column) -> Column:
        d, first, second = v["d"], v["first"], v["second"]
        inner = clamp((first * first + second * second - d * d) / _positive(2 * first * second), -1.0, 1.0)
        turn = 180 - F.degrees(F.acos(inner))
        along = (d * d + first * first - second * second) / (2 * d)
        off = side * F.sqrt(F.greatest(first * first - along * along, F.lit(0.0)))
        made = F.struct((v["ax"] + v["ux"] * along - v["uy"] * off).alias("x"), (v["ay"] + v["uy"] * along + v["ux"] * off).alias("y"), turn.alias("turn"))
        return F.when((d > 1) & (v["length"] >= d) & (turn <= most), made)

    return bind(F.struct(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), length.alias("length")), found)


def two_bends(ax: Column, ay: Column, bx: Column, by: Column, length: Column, shares: tuple[float, float], aim: float, side: Column, most: float = 55.0) -> Column:
    """Two vertices (x1, y1, x2, y2) and the greater turn of a line of three legs.

    The first leg leaves a by `aim` radians off the straight line; the second vertex is a bend of the rest.
    """
    def first(v: Column) -> Column:
        d = _positive(F.sqrt(F.pow(v["bx"] - v["ax"], 2) + F.pow(v["by"] - v["ay"], 2)))
        ux, uy, one = (v["bx"] - v["ax"]) / d, (v["by"] - v["ay"]) / d, shares[0] * v["length"]
        x1, y1 = v["ax"] + (ux * math.cos(aim) - uy * math.sin(aim)) * one, v["ay"] + (ux * math.sin(aim) + uy * math.cos(aim)) * one
        return bind(F.struct(*(v[c].alias(c) for c in ("ax", "ay", "bx", "by", "length")), d.alias("d"), x1.alias("x1"), y1.alias("y1")), second)

    def second(v: Column) -> Column:
        length = v["length"]
        two, three = (shares[1] - shares[0]) * length, (1 - shares[1]) * length
        rest = bend(v["x1"], v["y1"], v["bx"], v["by"], two + three, F.lit((shares[1] - shares[0]) / (1 - shares[0])), side, most)
        c = F.sqrt(F.pow(v["bx"] - v["x1"], 2) + F.pow(v["by"] - v["y1"], 2))
        fits = (v["d"] > 1) & (length >= v["d"]) & (c < two + three) & (c > F.abs(two - three) + 1e-9)
        return bind(F.struct(*(v[c].alias(c) for c in ("ax", "ay", "x1", "y1")), F.when(fits, rest).alias("rest")), third)

    def third(v: Column) -> Column:
        x2, y2, dx, dy = v["rest"]["x"], v["rest"]["y"], v["x1"] - v["ax"], v["y1"] - v["ay"]
        out = F.sqrt(F.pow(x2 - v["x1"], 2) + F.pow(y2 - v["y1"], 2)) * F.sqrt(dx * dx + dy * dy)
        turn = F.degrees(F.acos(clamp((dx * (x2 - v["x1"]) + dy * (y2 - v["y1"])) / _positive(out), -1.0, 1.0)))
        return F.when(v["rest"].isNotNull() & (turn <= most), F.struct(v["x1"], v["y1"], x2.alias("x2"), y2.alias("y2"), F.greatest(turn, v["rest"]["turn"]).alias("turn")))

    return bind(F.struct(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), length.alias("length")), first)
