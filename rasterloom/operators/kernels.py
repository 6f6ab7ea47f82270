"""Sequential tile algorithms on NumPy grids, run one tile a group by ``per_tile``.

A grid is z[y, x] with NaN for masked cells. A tile is bounded by its lattice, so a group is too.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .stencil import NEIGHBOURS


def grid_of(cells: pd.DataFrame) -> np.ndarray:
    z = np.full((int(cells.y.max()) + 1, int(cells.x.max()) + 1), np.nan)
    z[cells.y.to_numpy(), cells.x.to_numpy()] = cells.z.to_numpy()
    return z


def per_tile(cells: DataFrame, kernel: Callable[[np.ndarray], pd.DataFrame], columns: str) -> DataFrame:
    """Apply a kernel to each tile's grid; its rows get the tile's name."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = kernel(grid_of(rows))
        out.insert(0, "tile", key[0])
        return out

    return cells.groupBy("tile").applyInPandas(run, f"tile string, {columns}")


def label_components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels 1.. of connected true cells by their first cell in row order; 0 elsewhere."""
    labels = np.zeros(mask.shape, np.int32)
    steps = NEIGHBOURS if diagonal else NEIGHBOURS[:4]
    count = 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if labels[y, x]:
            continue
        count += 1
        labels[y, x] = count
        stack = [(y, x)]
        while stack:
            cy, cx = stack.pop()
            for dx, dy in steps:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and not labels[ny, nx]:
                    labels[ny, nx] = count
                    stack.append((ny, nx))
    return labels


def chamfer(mask: np.ndarray) -> np.ndarray:
    """Distance to the nearest true cell by two sweeps with steps of 1 and sqrt 2; inf without one.

    A sweep goes row by row: a row takes what the one before hands down, then passes it on along
    itself, which is a running minimum of distance less place.
    """
    d, diagonal = np.where(mask, 0.0, np.inf), np.sqrt(2.0)
    place = np.arange(mask.shape[1], dtype=float)
    # Down and rightwards, then up and leftwards: the same sweep of the grid turned half around.
    for grid in (d, d[::-1, ::-1]):
        for y in range(len(grid)):
            row = grid[y]
            if y:
                above = np.pad(grid[y - 1], 1, constant_values=np.inf)
                row = np.minimum(row, np.minimum(above[1:-1] + 1, np.minimum(above[:-2], above[2:]) + diagonal))
            grid[y] = np.minimum.accumulate(row - place) + place
    return d


def fill_depressions(z: np.ndarray, rise: float = 1e-6) -> np.ndarray:
    """Priority flood from the border and mask edges: every cell gets a falling way out."""
    h, w = z.shape
    # Plain lists with a border of done cells: cell by cell, arrays take several times as long.
    missing = np.pad(np.isnan(z), 1, constant_values=True)
    beside = np.any([missing[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dx, dy in NEIGHBOURS], axis=0)
    out, steps = np.pad(z.astype(float), 1, constant_values=np.nan).ravel().tolist(), [dy * (w + 2) + dx for dx, dy in NEIGHBOURS]
    edge = np.flatnonzero(np.pad(beside & ~np.isnan(z), 1))
    done = (missing.ravel() | np.isin(np.arange(missing.size), edge)).tolist()
    heap = [(out[at], at) for at in edge.tolist()]
    heapq.heapify(heap)
    while heap:
        level, at = heapq.heappop(heap)
        for step in steps:
            to = at + step
            if not done[to]:
                done[to] = True
                out[to] = max(out[to], level + rise)
                heapq.heappush(heap, (out[to], to))
    return np.array(out).reshape(h + 2, w + 2)[1:-1, 1:-1].astype(z.dtype)


def steepest(z: np.ndarray) -> np.ndarray:
    """Index into NEIGHBOURS of steepest descent, first on ties; -1 without descent."""
    h, w = z.shape
    padded = np.pad(z, 1, constant_values=np.nan)
    best, k_best = np.zeros((h, w)), np.full((h, w), -1)
    for k, (dx, dy) in enumerate(NEIGHBOURS):
        fall = (z - padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]) / np.hypot(dx, dy)
        better = np.nan_to_num(fall, nan=-1.0) > best
        best, k_best = np.where(better, fall, best), np.where(better, k, k_best)
    return k_best


def accumulate(z: np.ndarray) -> np.ndarray:
    """Cells that drain through each cell, itself included, over the steepest descent of z."""
    k, steps = steepest(z).ravel().tolist(), [dy * z.shape[1] + dx for dx, dy in NEIGHBOURS]
    area = np.where(np.isnan(z), 0.0, 1.0).ravel().tolist()
    order = np.argsort(-np.nan_to_num(z, nan=-np.inf), axis=None, kind="stable")
    for at in order.tolist():
        if k[at] >= 0:
            area[at + steps[k[at]]] += area[at]
    return np.array(area).reshape(z.shape)


def radial_spectrum(z: np.ndarray, bins: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Wave numbers and radially averaged power of the Hann-windowed, mean-free grid."""
    filled = np.where(np.isnan(z), np.nanmean(z), z)
    filled = (filled - filled.mean()) * np.outer(np.hanning(z.shape[0]), np.hanning(z.shape[1]))
    power = np.abs(np.fft.fft2(filled)) ** 2 / filled.size
    ky, kx = np.meshgrid(np.fft.fftfreq(z.shape[0]), np.fft.fftfreq(z.shape[1]), indexing="ij")
    k = np.hypot(kx, ky)
    edges = np.linspace(0.0, 0.5, bins + 1)
    which = np.digitize(k.ravel(), edges) - 1
    inside = (which >= 0) & (which < bins) & (k.ravel() > 0)
    count = np.bincount(which[inside], minlength=bins)
    mean = np.bincount(which[inside], weights=power.ravel()[inside], minlength=bins) / np.maximum(count, 1)
    return (edges[:-1] + edges[1:]) / 2, np.where(count > 0, mean, np.nan)


def spectral_slope(z: np.ndarray) -> float:
    """beta: minus the slope of log power over log wave number."""
    k, p = radial_spectrum(z)
    ok = np.isfinite(p) & (p > 0)
    return float(-np.polyfit(np.log10(k[ok]), np.log10(p[ok]), 1)[0]) if ok.sum() > 2 else float("nan")


def quadratic_residual(z: np.ndarray, degree: int = 2) -> np.ndarray:
    """z less its least-squares plane (1) or quadratic surface (2) over valid cells."""
    y, x = np.nonzero(~np.isnan(z))
    u, v = (x - x.mean()) / z.shape[1], (y - y.mean()) / z.shape[0]
    basis = [np.ones(len(u)), u, v] + ([u * u, u * v, v * v] if degree == 2 else [])
    a = np.stack(basis, 1)
    out = np.full_like(z, np.nan)
    out[y, x] = z[y, x] - a @ np.linalg.lstsq(a, z[y, x], rcond=None)[0]
    return out


def semivariogram(z: np.ndarray, lags: int) -> np.ndarray:
    """Half the mean squared difference of valid pairs at 1..lags cells, pooled over both axes."""
    out = np.full(lags, np.nan)
    for i in range(1, lags + 1):
        d = np.concatenate([(z[:, i:] - z[:, :-i]).ravel(), (z[i:, :] - z[:-i, :]).ravel()])
        d = d[np.isfinite(d)]
        if len(d):
            out[i - 1] = 0.5 * float(np.mean(d * d))
    return out


def fit_exponential(lag: np.ndarray, gamma: np.ndarray) -> tuple[float, float, float]:
    """nugget, sill and range of nugget + sill * (1 - exp(-3 h / range)): least squares over a range grid, bounded at 0."""
    ok = np.isfinite(gamma)
    lag, gamma = lag[ok], gamma[ok]
    best = (float("inf"), 0.0, 0.0, 0.0)
    if len(lag) < 3:
        return float("nan"), float("nan"), float("nan")
    for r in np.geomspace(max(lag[0], 1e-9) / 2, lag[-1] * 4, 200):
        rise = 1 - np.exp(-3 * lag / r)
        a = np.stack([np.ones_like(rise), rise], 1)
        nugget, sill = np.linalg.lstsq(a, gamma, rcond=None)[0]
        if nugget < 0:
            nugget, sill = 0.0, float(rise @ gamma / (rise @ rise))
        if sill < 0:
            nugget, sill = float(gamma.mean()), 0.0
        err = float(((gamma - nugget - sill * rise) ** 2).sum())
        if err < best[0]:
            best = (err, float(nugget), float(sill), float(r))
    return best[1:]


def component_shapes(labels: np.ndarray) -> pd.DataFrame:
    """(label, cells, elongation) by the principal axes of each component's cells."""
    rows = []
    for k in range(1, labels.max() + 1):
        y, x = np.nonzero(labels == k)
        if len(y) < 4:
            rows.append((k, len(y), 1.0))
            continue
        a, b, c = x.var(), y.var(), np.mean((x - x.mean()) * (y - y.mean()))
        root = np.sqrt((a - b) ** 2 + 4 * c * c)
        low = (a + b - root) / 2
        rows.append((k, len(y), float(np.sqrt((a + b + root) / 2 / max(low, 1e-9)))))
    return pd.DataFrame(rows, columns=["label", "cells", "elongation"])


def diffuse(z: np.ndarray, rate: float = 0.2, steps: int = 4) -> np.ndarray:
    """Explicit diffusion; nothing crosses edges or the mask, so the sum is kept."""
    out = z.copy()
    for _ in range(steps):
        flow = np.zeros_like(out)
        for axis in (0, 1):
            d = np.nan_to_num(np.diff(out, axis=axis)) * rate
            low = [slice(None)] * 2
            high = [slice(None)] * 2
            low[axis], high[axis] = slice(None, -1), slice(1, None)
            flow[tuple(low)] += d
            flow[tuple(high)] -= d
        out = out + flow
    return out


def shortest_walk(z: np.ndarray, start: tuple[int, int], goal: tuple[int, int], steep: float = 0.2) -> tuple[float, int]:
    """Cost and steps of the cheapest 8-connected walk (A*), a step costing length * (1 + steep * |rise|)."""
    far = lambda y, x: float(np.hypot(y - goal[0], x - goal[1]))
    heap, best, steps = [(far(*start), 0.0, start)], {start: 0.0}, {start: 0}
    while heap:
        _, cost, at = heapq.heappop(heap)
        if at == goal:
            return cost, steps[at]
        if cost > best[at]:
            continue
        for dx, dy in NEIGHBOURS:
            y, x = at[0] + dy, at[1] + dx
            if not (0 <= y < z.shape[0] and 0 <= x < z.shape[1]) or np.isnan(z[y, x]):
                continue
            new = cost + float(np.hypot(dx, dy)) * (1 + steep * abs(float(z[y, x] - z[at])))
            if new < best.get((y, x), float("inf")):
                best[y, x], steps[y, x] = new, steps[at] + 1
                heapq.heappush(heap, (new + far(y, x), new, (y, x)))
    return float("inf"), -1
