"""Fluvial erosion of one tile's heights: incision, graded deposition, talus and diffusion.

The receivers form a forest. Cells are put into levels by their steps to the base, so whatever
runs along the forest is one NumPy operation a level: from the base up for incision and the
graded profile, from the leaves down for sediment. Masked cells (NaN) neither move nor receive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .kernels import accumulate, diffuse, fill_depressions, steepest
from .stencil import NEIGHBOURS
from .water import downstream

# Fixed values of the pass: steps of diffusion, rise over run at rest and of fresh deposits,
# limits of the implicit factor and of an epoch's cut by the first relief, share of an excess moved.
SUBSTEPS, TALUS, GRADE, MOST_FACTOR, MOST_CUT, MOVED = 2, 0.7, 0.006, 1.5, 0.35, 0.125


@dataclass
class Eroded:
    """Heights and what became of them; sums are in cubic metres."""

    z: np.ndarray
    sediment: np.ndarray
    area: np.ndarray
    lake_depth: np.ndarray
    mass: dict[str, float] = field(default_factory=lambda: {"eroded": 0.0, "deposited": 0.0, "exported": 0.0})


def flow(z: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Receivers, distances to them and drained areas (flat), levels from the base up, and the filled heights."""
    filled = fill_depressions(z)
    k = steepest(filled)
    to, far = downstream(k), np.array([np.hypot(*s) for s in NEIGHBOURS] + [1.0])[k].ravel() * cell
    depth, here = np.zeros(z.size, np.int64), np.arange(z.size)
    jump = to.copy()
    depth[jump != here] = 1
    while (jump != jump[jump]).any():
        depth += depth[jump]
        jump = jump[jump]
    valid = np.flatnonzero(~np.isnan(z.ravel()))
    order = valid[np.argsort(depth[valid], kind="stable")]
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    return to, far, accumulate(filled).ravel() * cell * cell, levels, filled


def talus(z: np.ndarray, cell: float) -> np.ndarray:
    """A share of what is over the slope of rest goes to the neighbour that lies lowest beyond it."""
    h, w = z.shape
    wide = np.pad(z, 1, constant_values=np.nan)
    excess = np.stack([np.nan_to_num(z - wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] - TALUS * cell * np.hypot(dx, dy), nan=-1.0) for dx, dy in NEIGHBOURS])
    best = excess.argmax(0)
    given = MOVED * np.maximum(excess.max(0), 0.0)
    out = (z - given).ravel()
    np.add.at(out, downstream(best)[given.ravel() > 0], given.ravel()[given.ravel() > 0])
    return out.reshape(z.shape)


def erode(z: np.ndarray, cell: float, intensity: float, deposition: float, diffusion: float, contrast: float = 0.0, hardness: np.ndarray | None = None, epochs: int = 8) -> Eroded:
    """Run the epochs; every other one keeps the forest of the one before.

    hardness is in [-1, 1]: hard cells resist by `contrast`. Mass is kept: what is eroded is
    deposited, or exported where the forest ends (the border and the mask).
    """
    a0, shape = cell * cell, z.shape
    z = z.astype(float).ravel()
    top, relief = np.nanmax(z), max(np.nanmax(z) - np.nanmin(z), 1e-9)
    soft = np.maximum(1.0 - contrast * (np.zeros(z.size) if hardness is None else hardness.ravel()), 0.0)
    sediment, result = np.zeros(z.size), Eroded(z, z, z, z)
    for epoch in range(epochs):
        if epoch % 2 == 0:
            to, far, area, levels, _ = flow(z.reshape(shape), cell)
            factor = np.minimum(intensity / epochs * soft * np.sqrt(area) / far, MOST_FACTOR)
        cut, aim = np.zeros(z.size), z.copy()
        for i in levels[1:]:
            drop = z[i] - z[to[i]]
            cut[i] = np.clip(drop * factor[i] / (1 + factor[i]), 0.0, MOST_CUT * relief / epochs)
            z[i] -= cut[i]
        aim[levels[0]] = z[levels[0]]
        for i in levels[1:]:
            aim[i] = np.maximum(z[i], np.minimum(aim[to[i]] + GRADE * far[i], top))
        carried = np.zeros(z.size)
        for i in reversed(levels[1:]):
            laid = np.minimum(np.minimum(deposition * carried[i] / area[i], np.maximum(aim[i] - z[i], 0.0)), carried[i] / a0)
            z[i] += laid
            sediment[i] += laid
            result.mass["deposited"] += float(laid.sum()) * a0
            np.add.at(carried, to[i], carried[i] + (cut[i] - laid) * a0)
        result.mass["eroded"] += float(cut.sum()) * a0
        result.mass["exported"] += float(carried[levels[0]].sum())
        grid = talus(z.reshape(shape), cell)
        z = diffuse(grid, min(diffusion / (epochs * SUBSTEPS), 0.24), SUBSTEPS).ravel()
    _, _, area, _, filled = flow(z.reshape(shape), cell)
    result.z, result.sediment, result.area = z.reshape(shape), sediment.reshape(shape), area.reshape(shape)
    result.lake_depth = np.maximum(filled - result.z, 0.0)
    return result
