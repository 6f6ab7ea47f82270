"""Kernels on analytic surfaces, planted answers and conservation laws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import noise, scalars
from rasterloom.operators import erosion, kernels, polyline, stencil


def test_slope_of_a_plane(spark):
    cells = spark.range(16 * 16).select(F.lit("t").alias("tile"), (F.col("id") % 16).cast("int").alias("x"), F.floor(F.col("id") / 16).cast("int").alias("y")).withColumn("z", F.col("x") * 3.0 + F.col("y") * 4.0)
    assert stencil.slope(cells).select(F.min("slope"), F.max("slope")).first() == (5.0, 5.0)
    d = stencil.second_differences(cells)
    assert d.count() == 14 * 14 and d.agg(F.max(F.abs("fxx") + F.abs("fyy") + F.abs("fxy"))).first()[0] < 1e-9


def test_masked_cells_stay_out(spark):
    cells = spark.createDataFrame([("t", 0, 0, 1.0), ("t", 2, 0, 9.0), ("t", 3, 0, 11.0)], "tile string, x int, y int, z double")
    got = {r.x: r.gx for r in stencil.gradient(cells).collect()}
    assert got == {0: 0.0, 2: 2.0, 3: 2.0}


def test_components_and_shapes():
    mask = np.zeros((8, 8), bool)
    mask[0, 0] = mask[1, 1] = True
    mask[5, 2:8] = True
    assert kernels.label_components(mask).max() == 2
    assert kernels.label_components(mask, diagonal=False).max() == 3
    shapes = kernels.component_shapes(kernels.label_components(mask))
    assert list(shapes.cells) == [2, 6] and shapes.elongation[1] > 4


def test_chamfer_distance():
    mask = np.zeros((9, 9), bool)
    mask[4, 4] = True
    d = kernels.chamfer(mask)
    assert d[4, 8] == 4 and d[0, 0] == pytest.approx(4 * 2**0.5)


def test_filled_surfaces_drain():
    z = np.random.default_rng(1).random((20, 20)) * 10
    filled = kernels.fill_depressions(z)
    k = kernels.steepest(filled)
    assert (filled >= z).all() and (k[1:-1, 1:-1] >= 0).all()
    out = kernels.accumulate(filled)
    assert out[k < 0].sum() == z.size


def test_diffusion_keeps_mass_and_erosion_lowers():
    z = np.random.default_rng(2).random((16, 16)) * 30
    assert kernels.diffuse(z).sum() == pytest.approx(z.sum())
    assert erosion.erode(z, 1.0, 0.5, 0.0, 0.0).z.sum() < z.sum()


def test_spectrum_of_a_wave():
    z = np.sin(2 * np.pi * np.arange(64) / 8)[None, :].repeat(64, 0)
    k, p = kernels.radial_spectrum(z, 16)
    assert abs(k[np.nanargmax(p)] - 1 / 8) < 1 / 32


def test_variogram_fit_and_detrend():
    h = np.arange(1.0, 20.0)
    nugget, sill, reach = kernels.fit_exponential(h, 0.5 + 2 * (1 - np.exp(-3 * h / 9)))
    assert (nugget, sill, reach) == pytest.approx((0.5, 2, 9), rel=0.05)
    y, x = np.mgrid[:12, :12]
    assert np.abs(kernels.quadratic_residual(1.0 + x * 2 - y * y * 0.3 + x * y)).max() < 1e-8


def test_walk_goes_around():
    z = np.zeros((5, 5))
    z[:4, 2] = np.nan
    cost, steps = kernels.shortest_walk(z, (0, 0), (0, 4))
    assert steps == 8 and cost == pytest.approx(4 + 4 * 2**0.5)
    assert kernels.shortest_walk(np.where(np.arange(5) == 2, np.nan, z), (0, 0), (0, 4)) == (float("inf"), -1)


def test_noise_is_zero_on_the_lattice_and_bounded(spark):
    at = spark.createDataFrame([(x, y) for x in range(20) for y in range(20)], "x long, y long")
    got = at.select(noise.perlin(F.col("x") * 1.0, F.col("y") * 1.0, F.lit(7)).alias("on"), noise.fbm(F.col("x") * 0.37, F.col("y") * 0.37, F.lit(7)).alias("off")).collect()
    assert all(r.on == 0 for r in got) and 0 < max(abs(r.off) for r in got) <= 1.05


def test_scalars(spark):
    row = spark.range(1).select(scalars.smoothstep(0, 1, F.lit(0.5)).alias("a"), scalars.piecewise(F.lit(5.0), [(0.0, 0.0), (10.0, 4.0)]).alias("b"), scalars.to_unit(scalars.from_unit(F.lit(0.25), 2.0, 32.0, log=True), 2.0, 32.0, log=True).alias("c"), scalars.jaccard(scalars.name_tokens(F.lit("The Old Oak")), scalars.name_tokens(F.lit("old oak no 2"))).alias("d")).first()
    assert tuple(row) == pytest.approx((0.5, 2.0, 0.25, 2 / 3))


def test_resample_is_even(spark):
    points = spark.createDataFrame([(1, i, float(3 * i), float(4 * i)) for i in range(1, 6)], "line long, i int, px double, py double")
    got = polyline.resample(points, 2.5).orderBy("k").collect()
    assert [r.k for r in got] == list(range(8)) and got[3].px == pytest.approx(3 + 4.5)
