"""Texture, landform and drainage measures by tile: one Arrow group a tile, its grid bounded by the lattice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..operators import features, kernels
from ..operators import landforms as measure
from ..sources.tables import raster, written

QUERIES: dict = {}
#: Sequential or spectral tile measures, so no SQL; tests hold them against analytic surfaces.
ORACLES: dict = {}
#: Metres a cell of the raster.
CELL = 6.0


def query(f):
    QUERIES[f.__name__] = f
    return f


def _row(spark: SparkSession, sf_dir: str, names: str, kernel) -> DataFrame:
    """One row of doubles for each tile."""
    return kernels.per_tile(raster(spark, sf_dir), lambda z: pd.DataFrame([kernel(z)], columns=names.split()), ", ".join(f"{n} double" for n in names.split()))


@query
def rms_roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, sf_dir, "rms_small rms_middle rms_large", lambda z: [measure.roughness(z, CELL, w) for w in (18.0, 36.0, 72.0)])


@query
def roughness_organisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, sf_dir, "rough_cv rough_top10 rough_moran rough_block_ratio", lambda z: measure.organisation(z, CELL, 30.0, 60.0, 48.0))


@query
def extrema_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, sf_dir, "extrema_per_ha", lambda z: {"extrema_per_ha": measure.extrema_per_hectare(z, CELL, 12.0)})


@query
def tpi_landforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, sf_dir, "valley_count_km2 valley_elong valley_len_p90", lambda z: measure.valleys(z, CELL, 60.0, least_area=100.0))


@query
def slope_autocorr_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, sf_dir, "length", lambda z: {"length": measure.slope_correlation_length(z, CELL)})


@query
def anisotropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, sf_dir, "anisotropy_ratio anisotropy_orientation_deg", lambda z: measure.directional_ranges(z, CELL, 90.0))


@query
def hydrology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(spark, sf_dir, "drainage_density valley_spacing concavity_theta chan_len_p90", lambda z: measure.drainage(z, CELL, 400.0))


@query
def radial_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    def bins(z: np.ndarray) -> pd.DataFrame:
        k, power = measure.spectrum(z, CELL, 16)
        return pd.DataFrame({"bin": np.arange(len(k), dtype=np.int32), "wavelength": 1 / k, "power": power})

    return kernels.per_tile(raster(spark, sf_dir), bins, "bin int, wavelength double, power double")


@query
def psd_on_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = np.geomspace(14.0, 120.0, 30)

    def shared(z: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"bin": np.arange(len(axis), dtype=np.int32), "wavelength": axis, "power": measure.on_wavelengths(*measure.spectrum(z, CELL), axis)})

    return kernels.per_tile(raster(spark, sf_dir), shared, "bin int, wavelength double, power double")


@query
def spectral_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shares(z: np.ndarray) -> list[float]:
        k, power = measure.spectrum(z, CELL)
        beta = measure.band_slope(k, power, 15.0, 120.0)
        return [beta, (beta - 2) / 2, measure.short_wave_share(k, power, 30.0, 14.0)]

    return _row(spark, sf_dir, "beta hurst highfreq_frac", shares)


@query
def variogram_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fits(z: np.ndarray) -> pd.DataFrame:
        lag, gamma = np.arange(1.0, 16.0) * CELL, kernels.semivariogram(kernels.quadratic_residual(z), 15)
        return pd.DataFrame([{"model": name, **measure.fit_variogram(lag, gamma, name == "spherical")} for name in ("exponential", "spherical")])

    return kernels.per_tile(raster(spark, sf_dir), fits, "model string, variogram_nugget double, variogram_sill double, variogram_range double")


@query
def tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table, written sorted by tile and read again: scalars, and the vectors by their lengths and sums."""
    cells = raster(spark, sf_dir).withColumn("water", F.col("z") > 30).withColumn("tree", F.col("z") < 20)
    found = written(features.feature_table(cells, CELL).orderBy("tile"))
    return found.select("tile", *features.SCALARS, *(F.size(v).alias(f"{v}_size") for v in features.VECTORS), F.aggregate("slope_hist", F.lit(0.0), lambda a, x: a + x).alias("slope_hist_sum"))


@query
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the feature table, a row for each place on its shared axis."""
    found = features.feature_table(raster(spark, sf_dir), CELL)
    axes = spark.createDataFrame(list(features.axis_rows()), "vector string, place int, at double")
    long = found.unpivot("tile", list(features.VECTORS), "vector", "v").select("tile", "vector", F.posexplode("v").alias("place", "value"))
    return long.join(F.broadcast(axes), ["vector", "place"]).select("tile", "vector", "place", "at", "value")
