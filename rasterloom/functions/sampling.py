"""Draws of a world's knobs, its water and its pars from a key's hashes, as Column expressions.

A draw is a uniform number of a key and a name, so each row draws on its own, in any order and partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.ranking import hash_unit
from .layouts import relief_estimate, sigmoid
from .noise import bind
from .scalars import clamp, from_unit, smoothstep

#: Knobs in order: lower and upper end, by logarithm, whole numbers. Fixed values.
KNOBS = {
    "amplitude": (5.0, 200.0, True, False),
    "base_period": (200.0, 2200.0, True, False),
    "octaves": (3.0, 7.0, False, True),
    "lacunarity": (1.8, 2.3, False, False),
    "gain": (0.35, 0.75, False, False),
    "warp_amp": (0.0, 240.0, False, False),
    "warp_period": (300.0, 2200.0, True, False),
    "redistribution": (0.25, 4.0, True, False),
    "detail_amp": (0.1, 4.0, True, False),
    "detail_gain": (0.4, 0.72, False, False),
    "detail_octaves": (2.0, 5.0, False, True),
    "nugget_amp": (0.0, 0.35, False, False),
    "aniso_ratio": (1.0, 4.0, True, False),
    "intensity": (0.3, 6.5, True, False),
    "deposition": (0.1, 3.5, False, False),
    "hardness_contrast": (0.0, 0.8, False, False),
    "diffusion": (0.2, 3.0, False, False),
    "ridged_mix": (-0.8, 0.8, False, False),
    "relief_patchiness": (0.0, 0.8, False, False),
}
#: Jitter of a draw in unit space, how far lowland periods shrink, and the median cover of deep lowland. Fixed values.
JITTER, SHRINK, LOWLAND_COVER = 0.03, 0.5, 22.0
#: Water by relief: fixed values. Where lowland ends and rolling ground begins (m); the odds of a dry world (at a
#: relief, its logarithm's slope) and of one large lake (most, from, to); the median cover in per cent at two reliefs; the
#: spread of its logarithm and how much less it is in lowland; bounds of the cover and how lowland moves them.
LOWLAND, DRY, LAKE = (16.0, 30.0), (38.0, -2.44, 1.46), (0.14, 40.0, 80.0)
COVER, SPREAD, COVER_LOW, COVER_HIGH, LAKE_COVER = ((13.0, 3.2), (38.0, 2.2)), (0.9, 0.62), (0.3, 11.7), (12.0, 15.0), (9.0, 6.0)
#: Rivers from outside, larger and smaller: the share of worlds up to it, median and spread of the area's logarithm, its bounds, the least cover.
RIVERS = ((0.01, 1.8e8, 0.5, (1.0e8, 3.5e8), 5.5), (0.18, 2.0e7, 0.8, (8.0e6, 8.0e7), 4.0))
#: Area where streams begin (median, spread of its logarithm, weights of the cover's and of its own draw, bounds), runoff's
#: spread and bounds, and the least area of a body (flat, more on high ground, from, to).
STREAM, RUNOFF, BODY = (8.0e5, 0.6, (-0.4, 0.9165), (2.0e5, 5.0e6)), (0.35, (0.5, 2.2)), (4000.0, 4000.0, 45.0, 85.0)
#: Threes (and fives) of a nine with their weights; weights of orders that open or close with a three or repeat one. Fixed values.
MIXES = ((2, 0.62), (1, 0.20), (3, 0.13), (0, 0.03), (4, 0.02))
OPENER_3, CLOSER_3, TWICE_3, TWICE_5, TRIES = 0.15, 0.45, 0.10, 0.35, 64
#: Quantiles of lengths by par. Fixed values.
LENGTHS = {
    3: ((0.0, 120.0), (0.10, 143.0), (0.50, 176.0), (0.90, 216.0), (1.0, 260.0)),
    4: ((0.0, 265.0), (0.10, 321.0), (0.50, 395.0), (0.90, 447.0), (1.0, 490.0)),
    5: ((0.0, 425.0), (0.10, 453.0), (0.50, 507.0), (0.90, 555.0), (1.0, 600.0)),
}


def uniform(key: Column, name: str) -> Column:
    return hash_unit(F.concat(key, F.lit(f":{name}")))


def normal(key: Column, name: str) -> Column:
    """Nearly normal: twelve uniforms less 6."""
    return reduce(lambda a, b: a + b, (uniform(key, f"{name}{i}") for i in range(12))) - 6


def decoded(unit: Callable[[str], Column]) -> dict[str, Column]:
    """Knobs in real units from their unit numbers."""
    return {name: from_unit(clamp(unit(name)), low, high, log, whole) for name, (low, high, log, whole) in KNOBS.items()}


def lowland(log_relief: Column) -> Column:
    """1 in deep lowland, 0 from rolling ground on."""
    return 1 - smoothstep(*map(math.log, LOWLAND), log_relief)


def shrunk_period(amplitude: Column, period: Column, gain: Column, power: Column, intensity: Column) -> Column:
    """The base period, shorter in lowland, where it makes basins of a hole's size."""
    relief = relief_estimate(amplitude, period, gain, power, intensity)
    return clamp(period * (1 - SHRINK * lowland(F.log(F.greatest(relief, F.lit(1.0))))), 200.0, 2200.0)


def water(key: Column, relief: Column) -> dict[str, Column]:
    """Cover, river and channel draws of a world of this relief; every draw is made, whichever branch holds."""
    log = F.log(relief)
    low, cover_z = lowland(log), normal(key, "cover")
    dry = uniform(key, "dry") < sigmoid(DRY[1] + DRY[2] * (log - math.log(DRY[0])))
    lake = uniform(key, "lake") < LAKE[0] * smoothstep(*LAKE[1:], relief)
    (near, first), (far, second) = COVER
    usual = F.log(first + (second - first) * smoothstep(math.log(near), math.log(far), log))
    drawn = F.exp(usual + (math.log(LOWLAND_COVER) - usual) * low + (SPREAD[0] - SPREAD[1] * low) * cover_z)
    drawn = F.least(F.greatest(drawn, COVER_LOW[0] + COVER_LOW[1] * low), COVER_HIGH[0] + COVER_HIGH[1] * low)
    cover = F.when(lake, LAKE_COVER[0] + LAKE_COVER[1] * uniform(key, "lake_cover")).when(dry, 0.0).otherwise(drawn)
    which, size = uniform(key, "river"), normal(key, "river_size")
    river, covered = F.lit(0.0), cover
    for share, median, spread, bounds, least in reversed(RIVERS):
        here = (cover > 0) & ~lake & (which < share)
        river = F.when(here, clamp(F.exp(math.log(median) + spread * size), *bounds)).otherwise(river)
        covered = F.when(here, F.greatest(cover, F.lit(least))).otherwise(covered)
    own, mine = STREAM[2]
    return {
        "coverage": covered / 100,
        "lake_course": lake,
        "river_area": river,
        "stream_area_min": clamp(F.exp(math.log(STREAM[0]) + STREAM[1] * (own * cover_z + mine * normal(key, "channel"))), *STREAM[3]),
        "runoff": clamp(F.exp(RUNOFF[0] * normal(key, "runoff")), *RUNOFF[1]),
        "min_body_area": BODY[0] + BODY[1] * smoothstep(*BODY[2:], relief),
    }


def par_order(key: Column) -> Column:
    """Nine pars that add up to 36, as an array: a drawn mix in the first accepted of TRIES shuffles, else the likeliest of them."""
    u, threes, total = uniform(key, "mix") * sum(w for _, w in MIXES), F.lit(MIXES[-1][0]), 0.0
    steps = []
    for n, w in MIXES:
        total += w
        steps.append((total, n))
    for bound, n in reversed(steps):
        threes = F.when(u < bound, n).otherwise(threes)
    # Lambdas put their column in wherever it is used: what is used often is bound.
    pars = bind(threes, lambda n: F.concat(F.array_repeat(F.lit(3), n), F.array_repeat(F.lit(4), 9 - 2 * n), F.array_repeat(F.lit(5), n)))

    def tried(pars: Column, t: Column) -> Column:
        mark = lambda what: F.concat(key, F.lit(f":{what}"), t.cast("string"))
        ranked = F.array_sort(F.transform(pars, lambda p, i: F.struct(F.md5(F.concat(mark("order"), F.lit("-"), i.cast("string"))).alias("h"), p.alias("p"))))
        return bind(F.transform(ranked, lambda x: x["p"]), lambda order: bind(weight(order), lambda w: judged(order, w, hash_unit(mark("take")) < w, t)))

    def weight(order: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((F.get(order, i) == 3) & (F.get(order, i + 1) == 3), TWICE_3).when((F.get(order, i) == 5) & (F.get(order, i + 1) == 5), TWICE_5).otherwise(1.0))
        return F.when(order[0] == 3, OPENER_3).otherwise(1.0) * F.when(order[8] == 3, CLOSER_3).otherwise(1.0) * F.aggregate(pairs, F.lit(1.0), lambda a, x: a * x)

    def judged(order: Column, w: Column, accepted: Column, t: Column) -> Column:
        # Accepted ones first, in order; then by weight.
        return bind(accepted, lambda taken: F.struct(F.when(taken, 0).otherwise(1).alias("late"), F.when(taken, 0.0).otherwise(-F.round(w, 9)).alias("w"), t.alias("t"), order.alias("order")))

    # Try by try, and none after the first accepted one: a branch that isn't taken isn't evaluated.
    none = F.lit(None).cast("struct<late: int, w: double, t: int, order: array<int>>")
    first = lambda p: F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), none, lambda best, t: F.when(best["late"] == 0, best).otherwise(F.array_min(F.array(best, tried(p, t)))))
    return bind(pars, first)["order"]


def length_of(par: Column, share: Column) -> Column:
    """A length by par at a quantile."""
    from .scalars import piecewise

    out = F.lit(None).cast("double")
    for p, knots in LENGTHS.items():
        out = F.when(par == p, piecewise(share, list(knots))).otherwise(out)
    return out


def hole_lengths(key: Column, pars: Column) -> Column:
    """A length for each of nine pars: each from another ninth of the quantiles 0.06 to 0.94, dealt by hash."""
    dealt = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct(F.md5(F.concat(key, F.lit(":ninth"), i.cast("string"))).alias("h"), i.alias("i"))))
    share = lambda d, i: 0.06 + 0.88 * ((F.get(d, i)["i"] + hash_unit(F.concat(key, F.lit(":share"), i.cast("string")))) / 9.0)
    return bind(dealt, lambda d: F.transform(pars, lambda p, i: bind(share(d, i), lambda u: length_of(p, u))))
