"""The feature table of tiles: one call gives a tile's scalars and its vectors on shared axes.

SETTINGS holds every threshold, window and axis (metres unless named); another resolution or survey
passes its own. A measure that lacks enough cells is NaN and stays a column, so the schema is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources.tables import dealt
from . import landforms as measure
from .kernels import grid_of, quadratic_residual

#: Thresholds, windows and axes: fixed values of the feature contract, a parameter of every function here.
SETTINGS = {
    "flat_deg": 3.0,
    "steep_deg": 15.0,
    "slope_bin_deg": 1.5,
    "slope_most_deg": 45.0,
    "reliable_wavelength": 14.0,
    "band": (30.0, 400.0),
    "short_wave": 30.0,
    "psd_axis": (14.0, 900.0, 48),
    "lag_axis": (600.0, 40),
    "spherical": False,
    "roughness_windows": (30.0, 100.0, 300.0),
    "relief_windows": (100.0, 200.0),
    "rough_window": 30.0,
    "moran_lag": 60.0,
    "block": 350.0,
    "extrema_sigma": 12.0,
    "valley_radii": (60.0, 120.0),
    "drainage_area": 20000.0,
    "anisotropy_lag": 400.0,
    "fractions": 21,
}
SCALARS = (
    "relief_p95_p5 elev_std elev_skew elev_kurtosis hypsometric_integral slope_mean slope_median slope_p90 slope_p95 slope_skew frac_flat frac_steep "
    "spectral_slope_beta hurst_from_beta highfreq_energy_frac variogram_nugget variogram_sill variogram_range rms_roughness_small rms_roughness_mid rms_roughness_large "
    "mean_abs_profile_curv profile_curv_p90 mean_abs_plan_curv plan_curv_p90 laplacian_abs_mean laplacian_abs_p95 local_relief_mean_100 heterogeneity_index_100 "
    "local_relief_mean_200 heterogeneity_index_200 slope_autocorr_length rough_cv_30 rough_top10_30 rough_moran_60 rough_block_ratio_350 extrema_per_ha "
    "valley_count_km2_60 valley_elong_120 valley_len_p90_120 drainage_density valley_spacing concavity_theta chan_len_p90 anisotropy_ratio anisotropy_orientation_deg "
    "canopy_fraction water_fraction canopy_fraction_clip"
).split()
VECTORS = ("slope_hist", "radial_psd", "variogram", "hypsometric_curve")
NAN = float("nan")


def axes(settings: dict = SETTINGS) -> dict[str, np.ndarray]:
    """Shared axes: bin edges in degrees, wavelengths, lags and fractions of the height range."""
    low, high, n = settings["psd_axis"]
    longest, lags = settings["lag_axis"]
    step, most = settings["slope_bin_deg"], settings["slope_most_deg"]
    return {"slope_hist": np.linspace(0.0, most, round(most / step) + 1), "radial_psd": np.geomspace(low, high, n), "variogram": np.linspace(0.0, longest, lags), "hypsometric_curve": np.linspace(0.0, 1.0, settings["fractions"])}


def moments(v: np.ndarray) -> tuple[float, float, float]:
    """Population deviation, skewness and excess kurtosis; shape is 0 without spread."""
    d = v - v.mean()
    m2 = (d * d).mean()
    return float(np.sqrt(m2)), float((d**3).mean() / m2**1.5) if m2 > 0 else 0.0, float((d**4).mean() / m2**2 - 3) if m2 > 0 else 0.0


def semivariances(z: np.ndarray, cell: float, lags: np.ndarray) -> np.ndarray:
    """Half the mean squared difference of the detrended grid at each lag, over four directions; 0 at lag 0, NaN beyond the grid."""
    residual, out = quadratic_residual(z), np.full(len(lags), NAN)
    for i, lag in enumerate(lags):
        k, diagonal = round(lag / cell), round(lag / cell / np.sqrt(2))
        if k == 0:
            out[i] = 0.0
            continue
        d = np.concatenate([np.subtract(*measure.shifted(residual, dx, dy)).ravel() for dx, dy in ((k, 0), (0, k), (diagonal, diagonal), (-diagonal, diagonal))])
        d = d[np.isfinite(d)]
        out[i] = (d @ d) / len(d) / 2 if len(d) else NAN
    return out


def curvatures(z: np.ndarray, cell: float) -> dict[str, float]:
    """Means and upper quantiles of the size of profile and plan curvature and of the Laplacian; 0 on level ground."""
    names = ("mean_abs_profile_curv", "profile_curv_p90", "mean_abs_plan_curv", "plan_curv_p90", "laplacian_abs_mean", "laplacian_abs_p95")
    ok = ~np.isnan(z)
    if ok.sum() < 16:
        return dict.fromkeys(names, NAN)
    filled = measure.fill_nearest(z)
    fy, fx = np.gradient(filled, cell)
    fyy, fyx = np.gradient(fy, cell)
    _, fxx = np.gradient(fx, cell)
    p = fx * fx + fy * fy
    along, across = fxx * fx * fx + 2 * fyx * fx * fy + fyy * fy * fy, fxx * fy * fy - 2 * fyx * fx * fy + fyy * fx * fx
    level = p < 1e-8
    with np.errstate(divide="ignore", invalid="ignore"):
        profile = np.where(level, 0.0, np.abs(along / (p * (1 + p) ** 1.5 + 1e-6)))[ok]
        plan = np.where(level, 0.0, np.abs(across / (p**1.5 + 1e-6)))[ok]
    laplacian = np.abs(fxx + fyy)[ok]
    return dict(zip(names, map(float, (profile.mean(), np.percentile(profile, 90), plan.mean(), np.percentile(plan, 90), laplacian.mean(), np.percentile(laplacian, 95))), strict=True))


def relief_within(z: np.ndarray, cell: float, window: float) -> tuple[float, float]:
    """Mean range of heights in windows of so many metres, and its deviation over its mean."""
    ok = ~np.isnan(z)
    if not ok.any():
        return NAN, NAN
    width = max(1, round(window / cell))
    high = low = measure.fill_nearest(z)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (width // 2, width - 1 - width // 2)
        high, low = (how(np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, mode="symmetric"), width, axis=axis), axis=-1) for how, a in ((np.max, high), (np.min, low)))
    span = (high - low)[ok]
    return float(span.mean()), float(span.std() / span.mean()) if span.mean() > 0 else NAN


def compute(z: np.ndarray, cell: float, tree: np.ndarray | None = None, water: np.ndarray | None = None, settings: dict = SETTINGS) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """Scalars by name and vectors on the shared axes of one tile; masked cells are NaN in z."""
    s, on, ok = settings, axes(settings), ~np.isnan(z)
    out, vectors, v = dict.fromkeys(SCALARS, NAN), {k: np.full(len(a) - (k == "slope_hist"), NAN) for k, a in on.items()}, z[ok]
    if len(v) >= 2:
        low, high = v.min(), v.max()
        out["relief_p95_p5"] = float(np.subtract(*np.percentile(v, [95, 5])))
        flat = high - low < 1e-9
        out["hypsometric_integral"] = 0.5 if flat else float((v.mean() - low) / (high - low))
        share = on["hypsometric_curve"]
        vectors["hypsometric_curve"] = np.where(share <= 0.5, 1.0, 0.0) if flat else ((v - low) / (high - low) >= share[:, None]).mean(axis=1)
        a = measure.slope_degrees(z, cell)[ok]
        out |= dict(zip(("slope_median", "slope_p90", "slope_p95"), np.percentile(a, [50, 90, 95]).tolist(), strict=True))
        out |= {"slope_mean": float(a.mean()), "slope_skew": moments(a)[1], "frac_flat": float((a < s["flat_deg"]).mean()), "frac_steep": float((a > s["steep_deg"]).mean())}
        bins = np.floor(np.minimum(a, s["slope_most_deg"] - 1e-9) / s["slope_bin_deg"]).astype(int)
        vectors["slope_hist"] = np.bincount(bins, minlength=len(on["slope_hist"]) - 1) / len(a)
    if len(v) >= 4:
        out |= dict(zip(("elev_std", "elev_skew", "elev_kurtosis"), moments(v), strict=True))
    if len(v) >= 16:
        k, power = measure.spectrum(z, cell, len(on["radial_psd"]))
        vectors["radial_psd"] = measure.on_wavelengths(k, power, on["radial_psd"])
        out["spectral_slope_beta"] = beta = measure.band_slope(k, power, *s["band"])
        out["hurst_from_beta"] = (beta - 2) / 2
        out["highfreq_energy_frac"] = measure.short_wave_share(k, power, s["short_wave"], s["reliable_wavelength"])
        vectors["variogram"] = semivariances(z, cell, on["variogram"])
        out |= measure.fit_variogram(on["variogram"], vectors["variogram"], s["spherical"])
        out |= {f"rms_roughness_{n}": measure.roughness(z, cell, w) for n, w in zip(("small", "mid", "large"), s["roughness_windows"], strict=True)}
        out |= curvatures(z, cell)
        for window, tag in zip(s["relief_windows"], ("100", "200"), strict=True):
            out[f"local_relief_mean_{tag}"], out[f"heterogeneity_index_{tag}"] = relief_within(z, cell, window)
        out["slope_autocorr_length"] = measure.slope_correlation_length(z, cell)
        texture = measure.organisation(z, cell, s["rough_window"], s["moran_lag"], s["block"])
        out |= dict(zip(("rough_cv_30", "rough_top10_30", "rough_moran_60", "rough_block_ratio_350"), texture.values(), strict=True))
        out["extrema_per_ha"] = measure.extrema_per_hectare(z, cell, s["extrema_sigma"])
        near, wide = (measure.valleys(z, cell, r) for r in s["valley_radii"])
        out |= {"valley_count_km2_60": near["valley_count_km2"], "valley_elong_120": wide["valley_elong"], "valley_len_p90_120": wide["valley_len_p90"]}
        out |= measure.drainage(z, cell, s["drainage_area"])
        out |= measure.directional_ranges(z, cell, min(s["anisotropy_lag"], s["lag_axis"][0]))
    if water is not None:
        out["water_fraction"] = float(water.mean())
    if tree is not None:
        out["canopy_fraction"] = float(tree.mean())
        out["canopy_fraction_clip"] = float(tree[ok].mean()) if ok.any() else NAN
    return out, vectors


def feature_table(cells: DataFrame, cell: float, settings: dict = SETTINGS) -> DataFrame:
    """(tile, the 49 scalars, the 4 vectors as arrays) of cells(tile, x, y, z[, tree, water]), one tile a group."""
    layers = [c for c in ("tree", "water") if c in cells.columns]
    schema = ", ".join(["tile string", *(f"{n} double" for n in SCALARS), *(f"{n} array<double>" for n in VECTORS)])

    def row(rows: pd.DataFrame) -> dict:
        z, grids = grid_of(rows), {}
        for c in layers:
            grids[c] = np.zeros(z.shape, bool)
            grids[c][rows.y.to_numpy(), rows.x.to_numpy()] = rows[c].to_numpy(bool)
        scalars, vectors = compute(z, cell, grids.get("tree"), grids.get("water"), settings)
        return {"tile": rows.tile.iloc[0], **scalars, **{k: v.tolist() for k, v in vectors.items()}}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            tile = pd.factorize(rows.tile, use_na_sentinel=False)[0]
            ends = np.flatnonzero(tile[1:] != tile[:-1]) + 1
            # The last tile may go on in the next batch.
            held = rows.iloc[ends[-1] if len(ends) else 0 :]
            if len(ends):
                yield pd.DataFrame([row(rows.iloc[a:b]) for a, b in zip([0, *ends[:-1]], ends)])
        if held is not None:
            yield pd.DataFrame([row(held)])

    # As groups, each tile would be a batch, a table in and a table of one row out.
    columns = cells.select("tile", "x", "y", "z", *layers)
    return dealt(columns, "tile").sortWithinPartitions("tile").mapInPandas(run, schema)


def axis_rows(settings: dict = SETTINGS) -> Iterator[tuple[str, int, float]]:
    """(vector, place, value) of the shared axes, for a dimension table."""
    for name, values in axes(settings).items():
        yield from ((name, i, float(x)) for i, x in enumerate(values))
