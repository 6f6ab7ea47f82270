"""Channels, basins, wetlands, outlines and sites of one tile; kernels for ``per_tile``."""

from __future__ import annotations

import numpy as np

from .kernels import accumulate, chamfer, fill_depressions, label_components, steepest
from .stencil import NEIGHBOURS


def downstream(k: np.ndarray) -> np.ndarray:
    """Flat index of the cell that each cell drains to, itself where it drains nowhere."""
    h, w = k.shape
    steps = np.array([dy * w + dx for dx, dy in NEIGHBOURS] + [0])
    return (np.arange(h * w).reshape(h, w) + steps[k]).ravel()


def reaches(channel: np.ndarray, to: np.ndarray) -> list[list[int]]:
    """Flat cells of each stream from a head or a junction down to the next junction or the end of the channel.

    Streams from heads come first, by cell; a junction is the last cell of each stream that meets
    there and the first of the one that goes on.
    """
    on = channel.ravel()
    cells = np.flatnonzero(on & (to != np.arange(len(to))))
    cells = cells[on[to[cells]]]
    above = np.bincount(to[cells], minlength=len(to))
    goes_on = np.zeros(len(to), bool)
    goes_on[cells] = True
    out = []
    for start in [*np.flatnonzero(on & (above == 0)), *np.flatnonzero(on & (above > 1))]:
        path = [int(start)]
        while goes_on[path[-1]] and (len(path) == 1 or above[path[-1]] < 2):
            path.append(int(to[path[-1]]))
        if len(path) > 1:
            out.append(path)
    return out


def stream_table(z: np.ndarray, cell: float, least_area: float, runoff: float):
    """Rows (stream, cells, length, width, area) of the streams that drain at least so much."""
    import pandas as pd

    filled = fill_depressions(z)
    area = accumulate(filled) * cell * cell
    to, flat = downstream(steepest(filled)), area.ravel()
    rows = []
    for i, path in enumerate(reaches((area >= least_area) & ~np.isnan(z), to)):
        y, x = np.divmod(np.array(path), z.shape[1])
        step = np.hypot(np.diff(x), np.diff(y)) * cell
        width = np.clip(0.005 * np.sqrt(runoff * flat[path]), 2.5, 90)
        rows.append((i, len(path), float(step.sum()), float(width.mean()), float((step * (width[1:] + width[:-1]) / 2).sum())))
    return pd.DataFrame(rows, columns=["stream", "cells", "length", "width", "area"])


def height_above_drainage(z: np.ndarray, filled: np.ndarray, channel: np.ndarray) -> np.ndarray:
    """Height over the channel cell that a cell drains to; NaN where it reaches none."""
    to, out = downstream(steepest(filled)), np.full(z.size, np.nan)
    level = np.where(channel, z, np.nan).ravel()
    for at in np.argsort(filled, axis=None, kind="stable"):
        if np.isnan(level[at]):
            level[at] = level[to[at]]
        out[at] = z.flat[at] - level[at]
    return out.reshape(z.shape)


def wetlands(z: np.ndarray, cell: float, least_area: float, steepest_slope: float, most: int) -> np.ndarray:
    """Flat cells lowest above their drainage, gentle enough, outside the channels; at most so many, first cell on ties."""
    filled = fill_depressions(z)
    channel = accumulate(filled) * cell * cell >= least_area
    hand = height_above_drainage(z, filled, channel)
    gy, gx = np.gradient(filled, cell)
    with np.errstate(invalid="ignore"):
        fits = np.flatnonzero((~channel & (hand >= 0) & (np.hypot(gx, gy) < steepest_slope)).ravel())
    return fits[np.argsort(hand.ravel()[fits], kind="stable")][:most]


def basins(z: np.ndarray, cell: float, least_depth: float, least_cells: int):
    """Rows (basin, cells, depth, volume, surface) of the depressions of a tile, by falling depth times area."""
    import pandas as pd

    filled = fill_depressions(z, 0.0)
    depth = np.nan_to_num(filled - z)
    labels = label_components(depth > 1e-9)
    rows = []
    for k in range(1, int(labels.max(initial=0)) + 1):
        inside = labels == k
        if inside.sum() >= least_cells and depth[inside].max() >= least_depth:
            rows.append((int(inside.sum()), float(depth[inside].max()), float(depth[inside].sum() * cell * cell), float(filled[inside].max())))
    rows.sort(key=lambda r: (-r[0] * r[1], r))
    return pd.DataFrame([(i, *r) for i, r in enumerate(rows)], columns=["basin", "cells", "depth", "volume", "surface"])


def signed_distance(mask: np.ndarray, cell: float, passes: int = 2) -> np.ndarray:
    """Smooth distance to a mask's outline, positive inside; -1e9 everywhere without a mask.

    The outline runs half a cell off the cells' centres. Smoothing is binomial, and a cell at least
    half a cell off keeps its side.
    """
    if not mask.any():
        return np.full(mask.shape, -1e9)
    half, least = cell / 2, 0.05
    far = lambda m: np.minimum(chamfer(m) * cell, 1e9)
    raw = np.where(mask, np.maximum(far(~mask) - half, least), -np.maximum(far(mask) - half, least))
    smooth = raw
    for _ in range(passes):
        for axis in (1, 0):
            wide = np.pad(smooth, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
            n = smooth.shape[axis]
            smooth = np.take(wide, range(n), axis) / 4 + smooth / 2 + np.take(wide, range(2, n + 2), axis) / 4
    lost = (np.abs(raw) >= half) & (smooth * np.sign(raw) < least)
    return np.where(lost, raw, smooth)


def line_cells(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Cells of the integer segment, ends included (Bresenham)."""
    x, y, right, down = x0, y0, abs(x1 - x0), abs(y1 - y0)
    sx, sy = (1 if b > a else -1 for a, b in ((x0, x1), (y0, y1)))
    error, out = right - down, [(x0, y0)]
    while (x, y) != (x1, y1):
        twice = 2 * error
        if twice >= -down:
            error, x = error - down, x + sx
        if twice <= right:
            error, y = error + right, y + sy
        out.append((x, y))
    return out


def largest_component(mask: np.ndarray) -> int:
    """Cells of the largest component, neighbours at corners included."""
    counts = np.bincount(label_components(mask).ravel())[1:]
    return int(counts.max(initial=0))


def thinned(score: np.ndarray, apart: float, most: int) -> np.ndarray:
    """Flat cells by falling score, then cell, each at least so far from those before; NaN scores are out."""
    h, w = score.shape
    order = np.argsort(-score, axis=None, kind="stable")
    order, kept = order[~np.isnan(score.ravel()[order])], []
    while len(order) and len(kept) < most:
        kept.append(int(order[0]))
        y, x = np.divmod(order, w)
        order = order[np.hypot(y - order[0] // w, x - order[0] % w) >= apart]
        order = order[order != kept[-1]]
    return np.array(kept, int)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of points (x, y), counterclockwise, without points on its edges."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p
    out: list = []
    for side in (p, p[::-1]):
        start = len(out)
        for q in side:
            while len(out) - start >= 2 and np.linalg.det([out[-1] - out[-2], q - out[-2]]) <= 0:
                out.pop()
            out.append(q)
        out.pop()
    return np.array(out)


def hull_mask(points: np.ndarray, shape: tuple[int, int], grow: int) -> np.ndarray:
    """Cells within the hull of the points, grown by so many steps to the four sides; all under three corners."""
    corners = convex_hull(points)
    if len(corners) < 3:
        return np.ones(shape, bool)
    y, x = np.indices(shape)
    mask = np.ones(shape, bool)
    for (ax, ay), (bx, by) in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        mask &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
    for _ in range(grow):
        wide = np.pad(mask, 1)
        mask = mask | wide[2:, 1:-1] | wide[:-2, 1:-1] | wide[1:-1, 2:] | wide[1:-1, :-2]
    return mask


def chained(start: np.ndarray, end: np.ndarray, number: np.ndarray, centre: np.ndarray, most: int = 18, jump: float = 400.0, out_of_turn: float = 140.0) -> np.ndarray:
    """Places of lines (start, end in metres, number or NaN) that make one round, by number, those without last.

    Costs stand in a matrix, from each line's end to each start, more where the number isn't the next. The
    round follows the least cost from the line of number 1 (or any) nearest the centre; it breaks
    off where that is a jump out of turn. Few enough lines are all taken, as they come.
    """
    n = len(start)
    if n <= most:
        return np.arange(n)
    gap = np.hypot(*(start[None] - end[:, None]).transpose(2, 0, 1))
    in_turn = number[None] == number[:, None] + 1
    cost = gap + np.where(in_turn, 0.0, out_of_turn)
    from_centre = np.hypot(*(start - centre).T)
    at = int(np.argmin(np.where(number == 1, from_centre, np.inf) if (number == 1).any() else from_centre))
    taken = [at]
    while len(taken) < min(n, most):
        cost[:, at] = np.inf
        following = int(np.argmin(cost[at]))
        if gap[at, following] > jump and not in_turn[at, following]:
            break
        taken.append(at := following)
    return np.array(taken)[np.argsort(number[taken], kind="stable")]


def outside_river(z: np.ndarray, cell: float, inflow: float) -> tuple[np.ndarray, np.ndarray]:
    """The flat cells of the longest way down from a border cell, and the drained area with an inflow added along it.

    Heights are filled first, so each way ends at the border. Ties go to the first cell in row order.
    """
    filled = fill_depressions(z)
    to, area = downstream(steepest(filled)), accumulate(filled) * cell * cell
    # How many steps are left from each cell: ways double in length until all have ended.
    here = np.arange(len(to))
    steps, reach = (to != here).astype(int), to
    while (reach != to[reach]).any():
        steps, reach = steps + steps[reach], reach[reach]
    h, w = z.shape
    border = np.zeros((h, w), bool)
    border[[0, -1]], border[:, [0, -1]] = True, True
    at = int(np.argmax(np.where(border.ravel(), steps, -1)))
    path = [at]
    while to[path[-1]] != path[-1]:
        path.append(int(to[path[-1]]))
    out = area.ravel().copy()
    out[path] += inflow
    return np.array(path), out.reshape(h, w)


def site_scores(z: np.ndarray, cell: float, wet: np.ndarray, flat: float = 0.12, radius: int = 5) -> np.ndarray:
    """How good a place is: higher than its surroundings, level within a step, away from water; NaN on water and steep ground."""
    gy, gx = np.gradient(z, cell)
    slope = np.hypot(gx, gy)
    steepest_near = np.max([np.roll(np.pad(slope, 1, mode="edge"), s, (0, 1))[1:-1, 1:-1] for s in [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]], axis=0)
    total, count = np.pad(z, radius), np.pad(np.ones_like(z), radius)
    for axis in (0, 1):
        total, count = (np.lib.stride_tricks.sliding_window_view(a, 2 * radius + 1, axis=axis).sum(-1) for a in (total, count))
    prominence = z - total / count
    away = np.minimum(chamfer(wet), 10.0) / 10.0 if wet.any() else np.ones_like(z)
    score = prominence / (np.abs(prominence).max() + 1e-9) + (1 - np.minimum(steepest_near / (flat * 4), 1)) + away
    return np.where(wet, np.nan, score)


def sites(score: np.ndarray, apart: float, closer: float, most: int, enough: int) -> np.ndarray:
    """Places by falling score, thinned; where there are under `enough`, those of a second pass that may lie closer follow."""
    first = thinned(score, apart, most)
    if len(first) >= enough:
        return first
    y, x = np.divmod(first, score.shape[1])
    rest, (ys, xs) = score.copy(), np.indices(score.shape)
    for a, b in zip(y, x, strict=True):
        rest[np.hypot(ys - a, xs - b) < closer] = np.nan
    return np.concatenate([first, thinned(rest, closer, most - len(first))])
