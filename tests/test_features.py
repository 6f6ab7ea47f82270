"""The feature table against its contract and analytic surfaces."""

import numpy as np
import pytest

from rasterloom.operators import features


def test_contract_shapes():
    y, x = np.mgrid[0:64, 0:64]
    scalars, vectors = features.compute(np.sin(x / 5.0) * 4 + np.cos(y / 7.0) * 3 + 0.01 * x, 6.0, water=np.zeros((64, 64), bool))
    assert list(scalars) == features.SCALARS and len(scalars) == 49
    assert {k: len(v) for k, v in vectors.items()} == {"slope_hist": 30, "radial_psd": 48, "variogram": 40, "hypsometric_curve": 21}
    assert {k for k, v in scalars.items() if np.isnan(v)} <= {"canopy_fraction", "canopy_fraction_clip", "valley_elong_120", "valley_len_p90_120", "rough_block_ratio_350", "concavity_theta", "chan_len_p90"}
    assert vectors["slope_hist"].sum() == pytest.approx(1) and vectors["variogram"][0] == 0 and vectors["hypsometric_curve"][0] == 1


def test_a_plane_and_a_flat_tile():
    y, x = np.mgrid[0:40, 0:40]
    scalars, vectors = features.compute(6.0 * x * np.tan(np.radians(10.0)), 6.0)
    assert scalars["slope_mean"] == pytest.approx(10) and scalars["frac_flat"] == 0 and scalars["elev_skew"] == pytest.approx(0, abs=1e-9)
    assert vectors["slope_hist"][6] == 1 and scalars["mean_abs_profile_curv"] == pytest.approx(0, abs=1e-9)
    assert scalars["hypsometric_integral"] == pytest.approx(0.5)
    flat, _ = features.compute(np.full((20, 20), 5.0), 6.0)
    assert flat["relief_p95_p5"] == 0 and flat["hypsometric_integral"] == 0.5 and flat["slope_mean"] == 0
    none, _ = features.compute(np.full((20, 20), np.nan), 6.0)
    assert all(np.isnan(v) for v in none.values())


def test_masked_cells_don_t_count():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(40, 40)).cumsum(0).cumsum(1)
    z[:10, :10] = np.nan
    tree = np.ones((40, 40), bool)
    tree[:10, :10] = False
    scalars, _ = features.compute(z, 6.0, tree=tree)
    assert scalars["elev_std"] == pytest.approx(np.nanstd(z)) and scalars["canopy_fraction_clip"] == 1 and scalars["canopy_fraction"] == pytest.approx(1 - 100 / 1600)
    assert scalars["relief_p95_p5"] == pytest.approx(np.nanpercentile(z, 95) - np.nanpercentile(z, 5))


def test_relief_window_is_the_range():
    z = np.zeros((30, 30))
    z[15, 15] = 9.0
    mean, _ = features.relief_within(z, 1.0, 5.0)
    assert mean == pytest.approx(9.0 * 25 / 900)


def test_campaign_runs_each_world_once(spark, monkeypatch):
    from rasterloom import catalogue
    from rasterloom.plans import worlds

    plans = []
    monkeypatch.setattr(worlds, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    catalogue.QUERIES["campaign_features"](spark, "/root/testdata/sf0.001")
    # Heights and features; no sort of all rows, whose sample runs all kernels again, and no hardness.
    assert len(plans) == 1 and plans[0].count("MapInPandas") == 2 and "FlatMapGroups" not in plans[0] and "], true" not in plans[0] and "Window" not in plans[0]


def test_tiles_that_batches_cut_stay_whole(spark):
    rng = np.random.default_rng(5)
    grids = {None if k == 3 else f"t{k}": rng.normal(0, 5, (9 + k, 12)) for k in range(7)}
    rows = [(t, x, y, float(z[y, x])) for t, z in grids.items() for y in range(z.shape[0]) for x in range(z.shape[1])]
    cells = spark.createDataFrame(rows, "tile string, x int, y int, z double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    got = {r.tile: r for r in features.feature_table(cells, 6.0).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) == set(grids)
    for t, z in grids.items():
        scalars, vectors = features.compute(z, 6.0)
        assert np.allclose(np.array([got[t][n] for n in features.SCALARS], float), [scalars[n] for n in features.SCALARS], equal_nan=True)
        assert all(np.allclose(np.array(got[t][n], float), vectors[n], equal_nan=True) for n in features.VECTORS)
