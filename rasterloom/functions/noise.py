"""Lattice gradient noise on unsigned 32-bit arithmetic, as Column expressions."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import smoothstep

#: Hash multipliers and octave step: fixed values.
GOLDEN, MUL_X, MUL_Y, MUL_END = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F
#: The eight gradients by the hash's low bits: fixed values.
DIAGONAL = sqrt(0.5)
GRADIENTS = ((1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0), (DIAGONAL, DIAGONAL), (-DIAGONAL, DIAGONAL), (DIAGONAL, -DIAGONAL), (-DIAGONAL, -DIAGONAL))
MASK = (1 << 32) - 1


def u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def times(a: Column, by: int) -> Column:
    """a * by modulo 2^32 in two 16-bit halves, which stay within 64 bits."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
    return u32(low * F.lit(by) + F.shiftleft((high * F.lit(by)).bitwiseAND(F.lit(0xFFFF)), 16))


def bind(value: Column, then) -> Column:
    """then(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def lattice_hash(x: Column, y: Column, seed: Column) -> Column:
    """Hash of integer lattice coordinates and a seed, in [0, 2^32)."""
    fold = lambda h, k: bind(h, lambda v: v.bitwiseXOR(F.shiftright(v, k)))
    h = u32(seed.cast("long")).bitwiseXOR(F.lit(GOLDEN))
    h = fold(u32(h + times(u32(x.cast("long")), MUL_X)), 15)
    h = fold(u32(h + times(u32(y.cast("long")), MUL_Y)), 13)
    return fold(bind(h, lambda v: times(v, MUL_END)), 16)


def perlin(x: Column, y: Column, seed: Column) -> Column:
    """Gradient noise, about [-1, 1]; zero at lattice points.

    The four corners run through one expression, as do the octaves of fbm, so that plans stay small.
    """
    corners = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (0, 1), (1, 1))))
    gradients = [F.array(*(F.lit(v[i]) for v in GRADIENTS)) for i in (0, 1)]
    ease = lambda t: t * t * t * (t * (t * 6.0 - 15.0) + 10.0)

    def cell(v: Column) -> Column:
        def corner(c: Column) -> Column:
            low = lattice_hash(v["x0"] + c["i"], v["y0"] + c["j"], seed).bitwiseAND(F.lit(7)).cast("int")
            return bind(low, lambda k: F.get(gradients[0], k) * (v["dx"] - c["i"]) + F.get(gradients[1], k) * (v["dy"] - c["j"]))

        def blend(g: Column) -> Column:
            low, high = g[0] + v["u"] * (g[1] - g[0]), g[2] + v["u"] * (g[3] - g[2])
            return (low + v["v"] * (high - low)) * sqrt(2.0)

        return bind(F.transform(corners, corner), blend)

    def placed(v: Column) -> Column:
        dx, dy = v["x"] - v["x0"], v["y"] - v["y0"]
        return bind(F.struct(v["x0"], v["y0"], dx.alias("dx"), dy.alias("dy"), ease(dx).alias("u"), ease(dy).alias("v")), cell)

    return bind(F.struct(x.alias("x"), y.alias("y"), F.floor(x).alias("x0"), F.floor(y).alias("y0")), placed)


def fbm(x: Column, y: Column, seed: Column, octaves: int = 3, lacunarity: float = 2.0, gain: float = 0.5) -> Column:
    """Octaves of noise by falling amplitude, divided by the amplitudes' sum."""
    each, amp, freq = [], 1.0, 1.0
    for o in range(octaves):
        each.append((o * GOLDEN & MASK, amp, freq))
        amp, freq = amp * gain, freq * lacunarity
    rows = F.array(*(F.struct(F.lit(s).alias("step"), F.lit(a).alias("amp"), F.lit(f).alias("freq")) for s, a, f in each))
    total = F.aggregate(rows, F.lit(0.0), lambda t, o: t + o["amp"] * perlin(x * o["freq"], y * o["freq"], u32(seed + o["step"])))
    return total / sum(a for _, a, _ in each)


def composed(height: Column, slope: Column, lake: Column, water: Column, detail: Column, patch: Column, amplitude: float, floor: float, patchiness: float, ramp: tuple[float, float] = (0.02, 0.05)) -> Column:
    """A landform's height with fine detail: full on slopes, a floor of it on flats, none on lake beds and water.

    detail and patch are noise about [-1, 1]; patchiness gathers the detail where patch is high (0: evenly).
    """
    steep = floor + (1 - floor) * smoothstep(*ramp, slope)
    gate = steep * (1 - smoothstep(0.02, 0.10, lake)) * F.greatest(1 - water, F.lit(0.0))
    return height + amplitude * gate * F.greatest(1 + patchiness * patch, F.lit(0.0)) * detail


# Steps and multipliers of the seed mixer: fixed values.
SEED_STEP, CHANNEL_STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None))


def _pair(high: Column, low: Column) -> Column:
    return F.struct(high.alias("high"), low.alias("low"))


def _times64(v: Column, by: int) -> Column:
    """A (high, low) pair of 32-bit halves times a 64-bit number, modulo 2^64."""
    b1, b0 = by >> 32, by & MASK
    first, second = v["low"].bitwiseAND(F.lit(0xFFFF)) * F.lit(b0), F.shiftright(v["low"], 16) * F.lit(b0)
    low = first.bitwiseAND(F.lit(MASK)) + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16)
    high = F.shiftright(first, 32) + F.shiftright(second, 16) + F.shiftright(low, 32) + times(v["low"], b1) + times(v["high"], b0)
    return _pair(u32(high), u32(low))


def _fold64(v: Column, by: int) -> Column:
    """v xor (v >> by) of a pair, by under 32."""
    moved = F.shiftright(v["low"], by).bitwiseOR(u32(F.shiftleft(v["high"], 32 - by)))
    return _pair(v["high"].bitwiseXOR(F.shiftright(v["high"], by)), v["low"].bitwiseXOR(moved))


def mix_seed(seed: Column, channel: int) -> Column:
    """The 32-bit noise seed of a 64-bit seed (a bigint's bits) and a channel."""
    step = SEED_STEP + channel * CHANNEL_STEP
    low = u32(seed.cast("long")) + F.lit(step & MASK)
    high = u32(F.shiftright(seed.cast("long"), 32)) + F.lit(step >> 32 & MASK) + F.shiftright(low, 32)
    v = _pair(u32(high), u32(low))
    for shift, by in MIX:
        v = bind(v, lambda z: _fold64(z, shift))
        if by:
            v = bind(v, lambda z: _times64(z, by))
    return v["low"]
