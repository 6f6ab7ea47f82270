"""Noise terrain: stretched, warped, ridged, redistributed and patchy octave noise.

A height is a function of its own point, so points stay where they are and NumPy works on Arrow
batches of them. The noise has Column expressions too (functions.noise), which suit single
lookups: octaves of warped points grow to expressions past the limits of code generation, and
took 28 s in a test session for 16,384 points, where batches take 1 to 3 s.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..functions import noise

# Noise channels of a seed and the period of patches in metres: fixed values.
BASE, WARP_X, WARP_Y, HARD, STRATA, PATCH = 0, 1, 2, 4, 5, 8
PATCH_PERIOD, HARD_PERIOD = 1100.0, 450.0


@dataclass(frozen=True)
class Shape:
    """Knobs of a terrain; each default but the first three leaves the noise as it is."""

    amplitude: float = 20.0
    period: float = 700.0
    octaves: int = 5
    lacunarity: float = 2.0
    gain: float = 0.5
    stretch: float = 1.0
    angle: float = 0.0
    warp: float = 0.0
    warp_period: float = 900.0
    ridged: float = 0.0
    power: float = 1.0
    patchiness: float = 0.0


def mix_seed(seed: np.ndarray, channel: int) -> np.ndarray:
    """32-bit noise seeds of 64-bit seeds and a channel."""
    z = seed.astype(np.int64).view(np.uint64) + np.uint64(noise.SEED_STEP + channel * noise.CHANNEL_STEP & (1 << 64) - 1)
    for shift, by in noise.MIX:
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by or 1)
    return (z & np.uint64(noise.MASK)).astype(np.uint32)


def lattice_hash(x: np.ndarray, y: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = (seed ^ np.uint32(noise.GOLDEN)) + x.astype(np.int64).astype(np.uint32) * np.uint32(noise.MUL_X)
    h = (h ^ (h >> np.uint32(15))) + y.astype(np.int64).astype(np.uint32) * np.uint32(noise.MUL_Y)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(noise.MUL_END)
    return h ^ (h >> np.uint32(16))


def perlin(x: np.ndarray, y: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Gradient noise, about [-1, 1]; zero at lattice points."""
    x0, y0 = np.floor(x), np.floor(y)
    dx, dy = x - x0, y - y0
    u, v = (t * t * t * (t * (t * 6 - 15) + 10) for t in (dx, dy))
    slopes = np.array(noise.GRADIENTS)

    def corner(i: int, j: int) -> np.ndarray:
        g = slopes[lattice_hash(x0 + i, y0 + j, seed) & np.uint32(7)]
        return g[:, 0] * (dx - i) + g[:, 1] * (dy - j)

    low, high = (corner(0, j) + u * (corner(1, j) - corner(0, j)) for j in (0, 1))
    return (low + v * (high - low)) * math.sqrt(2)


def fbm(x: np.ndarray, y: np.ndarray, seed: np.ndarray, octaves: int, lacunarity: float = 2.0, gain: float = 0.5) -> np.ndarray:
    """Octaves of noise by falling amplitude, divided by the amplitudes' sum."""
    steps = [(gain**o, lacunarity**o, np.uint32(o * noise.GOLDEN & noise.MASK)) for o in range(octaves)]
    return sum(a * perlin(x * f, y * f, seed + s) for a, f, s in steps) / sum(a for a, _, _ in steps)


def stretched(x: np.ndarray, y: np.ndarray, ratio: float, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Points turned into the grain's frame, scaled by the root of the ratio along it and its inverse across, and turned back."""
    if ratio == 1.0:
        return x, y
    s, c, r = math.sin(angle), math.cos(angle), math.sqrt(ratio)
    u, v = (x * c + y * s) * r, (y * c - x * s) / r
    return u * c - v * s, u * s + v * c


def redistributed(n: np.ndarray, power: float) -> np.ndarray:
    """Noise on a power curve, its median kept at 0: basins over 1, plateaus under it."""
    if power == 1.0:
        return n
    u = np.clip((n + 1) / 2, 0, 1)
    curve, middle = (u**power, 0.5**power) if power > 1 else (1 - (1 - u) ** (1 / power), 1 - 0.5 ** (1 / power))
    return 2 * (curve - middle)


def height(px: np.ndarray, py: np.ndarray, seed: np.ndarray, shape: Shape) -> np.ndarray:
    x, y = stretched(px, py, shape.stretch, shape.angle)
    if shape.warp:
        x, y = (a + shape.warp * perlin(x / shape.warp_period, y / shape.warp_period, mix_seed(seed, c)) for a, c in ((x, WARP_X), (y, WARP_Y)))
    n = fbm(x / shape.period, y / shape.period, mix_seed(seed, BASE), shape.octaves, shape.lacunarity, shape.gain)
    if shape.ridged:
        n = (1 - abs(shape.ridged)) * n + shape.ridged * (1 - 2 * np.abs(n))
    n = redistributed(n, shape.power)
    if shape.patchiness:
        n = n * (1 + shape.patchiness * perlin(px / PATCH_PERIOD, py / PATCH_PERIOD, mix_seed(seed, PATCH)))
    return n * shape.amplitude


def _with(rows: DataFrame, name: str, value) -> DataFrame:
    """rows with a double of each batch's columns, in place."""

    def run(batches):
        for batch in batches:
            yield batch.assign(**{name: value(batch)})

    return rows.mapInPandas(run, StructType([*rows.schema.fields]).add(name, DoubleType()))


def heights(points: DataFrame, shape: Shape) -> DataFrame:
    """points(seed, px, py), in metres, with z. Rows need all three values."""

    def value(b: pd.DataFrame) -> np.ndarray:
        return height(b.px.to_numpy(float), b.py.to_numpy(float), b.seed.to_numpy(np.int64), shape)

    return _with(points, "z", value)


def hardness(cells: DataFrame, group: str, shape: Shape) -> DataFrame:
    """cells(group, seed, px, py, z) with hardness in [-1, 1]: broad noise in plan and strata over height.

    Strata are a quarter of the group's relief (2nd to 98th percentile, at least 4 m) thick. The relief comes
    by a window: a join with itself would compute cells twice, and Spark takes rows exploded from a small
    table for few and would broadcast them.
    """
    w = Window.partitionBy(group)
    relief = cells.withColumn("__p", F.percentile("z", F.array(F.lit(0.02), F.lit(0.98))).over(w))
    thick = relief.withColumn("__thick", F.greatest(F.col("__p")[1] - F.col("__p")[0], F.lit(4.0)) / 4.0).drop("__p")

    def value(b: pd.DataFrame) -> np.ndarray:
        seed = b.seed.to_numpy(np.int64)
        x, y = stretched(b.px.to_numpy(float), b.py.to_numpy(float), shape.stretch, shape.angle)
        layer = b.z.to_numpy(float) / b["__thick"].to_numpy(float)
        return np.clip(0.6 * fbm(x / HARD_PERIOD, y / HARD_PERIOD, mix_seed(seed, HARD), 2) + 0.4 * perlin(layer, np.full(len(layer), 0.5), mix_seed(seed, STRATA)), -1, 1)

    return _with(thick, "hardness", value).drop("__thick")
