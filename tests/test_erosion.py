"""The erosion pass: mass, order of levels, hardness, talus and rest."""

import numpy as np
import pytest

from rasterloom.operators import erosion

RNG = np.random.default_rng(2)
Y, X = np.indices((40, 48))
HILLS = 30 * np.sin(X / 9.0) + 20 * np.cos(Y / 7.0) + RNG.normal(size=X.shape)


def test_levels_run_from_the_base():
    to, far, area, levels, filled = erosion.flow(HILLS, 12.5)
    level = np.empty(HILLS.size, int)
    for n, cells in enumerate(levels):
        level[cells] = n
    assert sum(map(len, levels)) == HILLS.size
    assert (to[levels[0]] == levels[0]).all()
    assert all((level[to[c]] == n).all() for n, c in enumerate(levels[1:]))
    assert area[levels[0]].sum() == pytest.approx(HILLS.size * 12.5**2)
    assert set(np.round(far / 12.5, 6)) <= {1.0, round(float(np.sqrt(2)), 6)}


def test_mass_is_kept():
    got = erosion.erode(HILLS, 12.5, 0.8, 1.0, 0.3)
    m = got.mass
    assert m["eroded"] > 0 and m["deposited"] > 0
    assert m["eroded"] == pytest.approx(m["deposited"] + m["exported"])
    assert (HILLS.sum() - got.z.sum()) * 12.5**2 == pytest.approx(m["exported"], rel=1e-6)
    assert (got.lake_depth >= 0).all() and (got.sediment >= 0).all()


def test_no_intensity_only_smooths():
    gentle = HILLS / 50
    got = erosion.erode(gentle, 12.5, 0.0, 1.0, 0.0)
    assert np.allclose(got.z, gentle) and got.mass["eroded"] == 0


def test_hard_ground_is_cut_less():
    hard = np.where(X < 24, 1.0, -1.0)
    cut = HILLS - erosion.erode(HILLS, 12.5, 0.5, 0.0, 0.0, 0.8, hard).z
    plain = HILLS - erosion.erode(HILLS, 12.5, 0.5, 0.0, 0.0).z
    assert cut[:, :20].sum() < plain[:, :20].sum() and cut[:, 28:].sum() > plain[:, 28:].sum()


def test_talus_lowers_a_spike():
    z = np.zeros((9, 9))
    z[4, 4] = 100.0
    got = erosion.talus(z, 1.0)
    assert got[4, 4] < 100 and got.sum() == pytest.approx(100)
    assert (erosion.talus(np.zeros((5, 5)), 1.0) == 0).all()


def test_masked_cells_stay():
    z = HILLS.copy()
    z[10:15, 10:15] = np.nan
    got = erosion.erode(z, 12.5, 0.8, 1.0, 0.3)
    assert np.array_equal(np.isnan(got.z), np.isnan(z))
