"""Channels, basins, outlines and sites against brute force and drawn shapes."""

import numpy as np
import pytest

from rasterloom.operators import kernels, water

RNG = np.random.default_rng(11)
Y, X = np.indices((24, 30))


def test_streams_cover_the_channel_tree():
    z = RNG.normal(size=(24, 30)) + Y
    filled = kernels.fill_depressions(z)
    channel = kernels.accumulate(filled) >= 6
    to = water.downstream(kernels.steepest(filled))
    paths = water.reaches(channel, to)
    links = {(a, b) for p in paths for a, b in zip(p, p[1:], strict=False)}
    on = channel.ravel()
    want = {(i, int(to[i])) for i in np.flatnonzero(on) if to[i] != i and on[to[i]]}
    assert links == want and sum(len(p) - 1 for p in paths) == len(want)
    above = np.bincount([b for _, b in want], minlength=z.size)
    assert all(above[i] == 1 for p in paths for i in p[1:-1])


def test_height_above_drainage_by_walking():
    z = RNG.normal(size=(24, 30)) + Y
    filled = kernels.fill_depressions(z)
    channel = kernels.accumulate(filled) >= 20
    to, got = water.downstream(kernels.steepest(filled)), water.height_above_drainage(z, filled, channel).ravel()
    for i in range(z.size):
        at = i
        while not channel.flat[at] and to[at] != at:
            at = to[at]
        if channel.flat[at]:
            assert got[i] == pytest.approx(z.flat[i] - z.flat[at])
        else:
            assert np.isnan(got[i])


def test_wetlands_are_the_lowest_gentle_cells():
    z = np.abs(X - 15.0) * 0.01 + 0.02 * Y
    cells = water.wetlands(z, 1.0, 20.0, 1.0, 10)
    assert len(cells) == 10 and len(water.wetlands(z, 1.0, 20.0, 0.0, 10)) == 0


def test_a_bowl_is_a_basin():
    z = np.full((20, 20), 10.0)
    z[5:8, 5:9] = 7.0
    z[12, 12] = 9.9
    found = water.basins(z, 2.0, 0.5, 2)
    assert found.to_numpy().tolist() == [[0, 12, 3.0, 12 * 3 * 4.0, 10.0]]
    assert len(water.basins(np.zeros((5, 5)), 1.0, 0.1, 1)) == 0


def test_signed_distance_keeps_sides():
    mask = np.hypot(X - 15, Y - 12) < 6
    mask[2, 2] = True
    d = water.signed_distance(mask, 5.0)
    assert ((d > 0) == mask).all()
    assert d[12, 15] == pytest.approx(27.5, abs=6) and (water.signed_distance(mask & False, 5.0) == -1e9).all()
    assert np.isfinite(water.signed_distance(mask | True, 5.0)).all()


@pytest.mark.parametrize("end", [(7, 3), (-7, 3), (3, 7), (0, 0), (-4, -4), (0, -5)])
def test_lines_are_joined_and_near(end):
    cells = water.line_cells(0, 0, *end)
    assert cells[0] == (0, 0) and cells[-1] == end and len(cells) == max(map(abs, end)) + 1
    assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(cells, cells[1:], strict=False))
    size = max(1.0, float(np.hypot(*end)))
    assert all(abs(x * end[1] - y * end[0]) / size <= 0.71 for x, y in cells)


def test_thinning_is_greedy():
    score = RNG.integers(0, 5, (12, 12)).astype(float)
    score[0, 0] = np.nan
    got = water.thinned(score, 3.0, 9).tolist()
    kept = []
    for i in sorted((i for i in range(144) if i), key=lambda i: (-score.flat[i], i)):
        if len(kept) < 9 and all(np.hypot(i // 12 - j // 12, i % 12 - j % 12) >= 3 for j in kept):
            kept.append(i)
    assert got == kept
    assert len(water.thinned(score, 0.0, 200)) == 143


def test_hull_of_a_square_and_of_a_line():
    points = np.array([[2, 2], [8, 2], [8, 8], [2, 8], [5, 5], [5, 2]])
    assert {tuple(p) for p in water.convex_hull(points)} == {(2, 2), (8, 2), (8, 8), (2, 8)}
    mask = water.hull_mask(points, (12, 12), 0)
    assert mask.sum() == 49 and water.hull_mask(points, (12, 12), 1).sum() == 49 + 28
    assert water.hull_mask(points[:2], (4, 4), 0).all()


def test_largest_component():
    mask = np.zeros((5, 5), bool)
    mask[0, 0] = mask[1, 1] = mask[4, 4] = True
    assert water.largest_component(mask) == 2 and water.largest_component(mask & False) == 0


def test_rounds_follow_numbers_and_stop_at_jumps():
    def chained(lines):
        number = np.array([np.nan if n is None else float(n) for n, _ in lines])
        return water.chained(np.array([p[0] for _, p in lines]), np.array([p[-1] for _, p in lines]), number, np.zeros(2)).tolist()

    lines = [(i + 1, np.array([[i * 100.0, 0.0], [i * 100.0 + 90, 0.0]])) for i in range(20)]
    assert chained(lines) == list(range(18))
    other = [(i + 1, p + [0.0, 5000.0]) for i, (_, p) in enumerate(lines)]
    assert chained(lines[:12] + other[:3] + [(None, p + [9e4, 0.0]) for _, p in lines[:5]]) == list(range(12))
    assert chained(lines[:3]) == [0, 1, 2]


def test_outside_river_takes_the_longest_way():
    y, x = np.mgrid[0:30, 0:30]
    z = 100 - 1.0 * x + 0.5 * np.abs(y - 15.0)
    path, area = water.outside_river(z, 10.0, 7e5)
    to = water.downstream(kernels.steepest(kernels.fill_depressions(z)))

    def steps(i):
        n = 0
        while to[i] != i:
            i, n = to[i], n + 1
        return n

    border = [i for i in range(900) if i // 30 in (0, 29) or i % 30 in (0, 29)]
    assert len(path) - 1 == max(map(steps, border)) and path[0] in border
    plain = kernels.accumulate(kernels.fill_depressions(z)).ravel() * 100.0
    assert (area.ravel()[path] - plain[path] == 7e5).all() and (np.delete(area.ravel(), path) == np.delete(plain, path)).all()


def test_sites_are_dry_level_and_apart():
    y, x = np.mgrid[0:40, 0:40]
    z = 3 * np.exp(-((x - 10) ** 2 + (y - 10) ** 2) / 30) + 2 * np.exp(-((x - 30) ** 2 + (y - 28) ** 2) / 30)
    wet = (x - 30) ** 2 + (y - 10) ** 2 < 16
    score = water.site_scores(z, 6.0, wet)
    assert np.isnan(score[wet]).all() and np.nanargmax(score) in {yy * 40 + xx for yy in range(8, 13) for xx in range(8, 13)}
    got = water.sites(score, 12.0, 4.0, 20, 18)
    ys, xs = np.divmod(got, 40)
    gaps = [np.hypot(ys[i] - ys[j], xs[i] - xs[j]) for i in range(len(got)) for j in range(i)]
    few = water.thinned(score, 12.0, 20)
    assert len(got) == 20 > len(few) and min(gaps) >= 4 and (got[: len(few)] == few).all() and not wet.ravel()[got].any()
