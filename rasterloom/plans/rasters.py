"""Queries on the raster and on lattice noise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import noise
from ..operators import erosion as erode
from ..operators import kernels, stencil, terrain
from ..sources.tables import RASTER, SUPPLIER_TILES, dealt, raster, supplier_tiles, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


def beside(value: str, axis: str, step: int) -> str:
    other, name = ("y", "lag" if step < 0 else "lead") if axis == "x" else ("x", "lag" if step < 0 else "lead")
    w = f"OVER (PARTITION BY tile, {other} ORDER BY {axis})"
    return f"CASE WHEN {name}({axis}) {w} = {axis} + {step} THEN {name}({value}) {w} END"


SLOPE = f"""{RASTER}, n AS (SELECT *, {beside("z", "x", -1)} ax, {beside("z", "x", 1)} bx, {beside("z", "y", -1)} ay, {beside("z", "y", 1)} b_y FROM r),
g AS (SELECT tile, x, y, z, CASE WHEN ax IS NULL AND bx IS NULL THEN 0 ELSE (coalesce(bx, z) - coalesce(ax, z)) / ((ax IS NOT NULL)::INT + (bx IS NOT NULL)::INT) END gx, CASE WHEN ay IS NULL AND b_y IS NULL THEN 0 ELSE (coalesce(b_y, z) - coalesce(ay, z)) / ((ay IS NOT NULL)::INT + (b_y IS NOT NULL)::INT) END gy FROM n),
s AS (SELECT *, sqrt(gx * gx + gy * gy) slope FROM g)"""
SECOND = f"""{RASTER}, n AS (SELECT *, {beside("z", "x", -1)} ax, {beside("z", "x", 1)} bx, {beside("z", "y", -1)} ay, {beside("z", "y", 1)} b_y FROM r),
m AS (SELECT *, {beside("b_y", "x", 1)} - {beside("b_y", "x", -1)} - {beside("ay", "x", 1)} + {beside("ay", "x", -1)} d FROM n),
d2 AS (SELECT tile, x, y, z, (bx - ax) / 2 fx, (b_y - ay) / 2 fy, bx - 2 * z + ax fxx, b_y - 2 * z + ay fyy, d / 4 fxy FROM m WHERE bx IS NOT NULL AND ax IS NOT NULL AND b_y IS NOT NULL AND ay IS NOT NULL AND d IS NOT NULL)"""


@query(f"WITH {RASTER} SELECT tile, count(*) AS n_cells, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, round(avg(z), 6) AS z_mean FROM r GROUP BY tile")
def tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).groupBy("tile").agg(F.count("*").alias("n_cells"), r6(F.min("z")).alias("z_min"), r6(F.max("z")).alias("z_max"), r6(F.avg("z")).alias("z_mean"))


@query(f"""WITH {RASTER}, c AS (SELECT tile, z - avg(z) OVER (PARTITION BY tile) d FROM r), p AS (SELECT tile, avg(d * d) v, avg(d * d * d) m3, avg(d * d * d * d) m4 FROM c GROUP BY tile)
SELECT tile, round(sqrt(v), 6) AS z_std, round(CASE WHEN v > 0 THEN m3 / power(v, 1.5) ELSE 0 END, 6) AS z_skew, round(CASE WHEN v > 0 THEN m4 / (v * v) - 3 END, 6) AS z_kurtosis FROM p""")
def tile_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).groupBy("tile").agg(r6(F.stddev_pop("z")).alias("z_std"), r6(F.coalesce(F.skewness("z"), F.lit(0.0))).alias("z_skew"), r6(F.kurtosis("z")).alias("z_kurtosis"))


@query(f"WITH {RASTER} SELECT tile, round(quantile_cont(z, 0.98) - quantile_cont(z, 0.02), 6) AS relief_p2_p98, round(quantile_cont(z, 0.95) - quantile_cont(z, 0.05), 6) AS relief_p5_p95 FROM r GROUP BY tile")
def tile_percentile_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster(spark, sf_dir).groupBy("tile").agg(F.percentile("z", F.array(*map(F.lit, (0.02, 0.05, 0.95, 0.98)))).alias("p"))
    return p.select("tile", r6(F.col("p")[3] - F.col("p")[0]).alias("relief_p2_p98"), r6(F.col("p")[2] - F.col("p")[1]).alias("relief_p5_p95"))


@query(f"""WITH {RASTER}, o AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY z, y, x) lo, row_number() OVER (PARTITION BY tile ORDER BY z DESC, y, x) hi FROM r)
SELECT tile, max(CASE WHEN lo = 1 THEN x END) AS min_x, max(CASE WHEN lo = 1 THEN y END) AS min_y, max(CASE WHEN hi = 1 THEN x END) AS max_x, max(CASE WHEN hi = 1 THEN y END) AS max_y FROM o GROUP BY tile""")
def tile_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("x", "y")
    found = raster(spark, sf_dir).groupBy("tile").agg(F.min_by(at, F.struct("z", "y", "x")).alias("lo"), F.min_by(at, F.struct(-F.col("z"), "y", "x")).alias("hi"))
    return found.select("tile", F.col("lo.x").alias("min_x"), F.col("lo.y").alias("min_y"), F.col("hi.x").alias("max_x"), F.col("hi.y").alias("max_y"))


@query(f"WITH {SLOPE.replace(RASTER, SUPPLIER_TILES)} SELECT tile, count(*) AS n_cells, round(avg(slope), 6) AS mean_slope, round(max(slope), 6) AS steepest, round(avg((slope < 6)::INT), 6) AS play_share FROM s GROUP BY tile")
def supplier_tile_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes on a raster whose tiles grow in number with the data."""
    s = stencil.slope(supplier_tiles(spark, sf_dir))
    return s.groupBy("tile").agg(F.count("*").alias("n_cells"), r6(F.avg("slope")).alias("mean_slope"), r6(F.max("slope")).alias("steepest"), r6(F.avg((F.col("slope") < 6).cast("double"))).alias("play_share"))


@query()
def supplier_tile_drainage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled heights and drained cells on the same raster, one Arrow group a tile: the most that one cell drains."""
    from ..operators.landforms import fill_nearest

    most = lambda z: pd.DataFrame({"cells": [z.size], "most": [float(np.nanmax(kernels.accumulate(kernels.fill_depressions(fill_nearest(z)))))]})
    return kernels.per_tile(supplier_tiles(spark, sf_dir), most, "cells int, most double")


@query(f"WITH {SLOPE} SELECT tile, x, y, round(gx, 6) AS gx, round(gy, 6) AS gy, round(slope, 6) AS slope FROM s")
def slope_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.slope(raster(spark, sf_dir)).select("tile", "x", "y", r6("gx").alias("gx"), r6("gy").alias("gy"), r6("slope").alias("slope"))


@query(f"""WITH {SLOPE}, d AS (SELECT tile, degrees(atan(slope)) a FROM s), c AS (SELECT tile, a, a - avg(a) OVER (PARTITION BY tile) e FROM d)
SELECT tile, round(avg(a), 6) AS mean, round(quantile_cont(a, 0.5), 6) AS median, round(quantile_cont(a, 0.9), 6) AS p90, round(quantile_cont(a, 0.95), 6) AS p95, round(avg(e * e * e) / power(avg(e * e), 1.5), 6) AS skew, round(avg((a < 3)::INT), 6) AS frac_flat, round(avg((a > 15)::INT), 6) AS frac_steep FROM c GROUP BY tile""")
def slope_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    d = stencil.slope(raster(spark, sf_dir)).select("tile", F.degrees(F.atan("slope")).alias("a"))
    q = d.groupBy("tile").agg(F.avg("a").alias("mean"), F.percentile("a", F.array(*map(F.lit, (0.5, 0.9, 0.95)))).alias("p"), F.skewness("a").alias("skew"), F.avg((a < 3).cast("double")).alias("frac_flat"), F.avg((a > 15).cast("double")).alias("frac_steep"))
    return q.select("tile", r6("mean").alias("mean"), *(r6(F.col("p")[i]).alias(n) for i, n in enumerate(("median", "p90", "p95"))), *(r6(n).alias(n) for n in ("skew", "frac_flat", "frac_steep")))


@query(f"""WITH {SLOPE}, b AS (SELECT tile, floor(least(degrees(atan(slope)), 45 - 1e-9) / 1.5)::INT bin FROM s), c AS (SELECT tile, bin, count(*) k FROM b GROUP BY ALL), t AS (SELECT tile, sum(k) n FROM c GROUP BY tile)
SELECT t.tile, q.bin::INT AS bin, round(coalesce(k, 0) / n, 6) AS share FROM t CROSS JOIN (SELECT unnest(range(30)) bin) q LEFT JOIN c ON c.tile = t.tile AND c.bin = q.bin""")
def slope_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = 30
    found = stencil.slope(raster(spark, sf_dir)).select("tile", F.floor(F.least(F.degrees(F.atan("slope")), F.lit(45 - 1e-9)) / 1.5).cast("int").alias("bin"))
    counts = found.groupBy("tile").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("bin") == i, 1)).alias(f"b{i}") for i in range(bins)))
    return counts.select("tile", "n", F.posexplode(F.array(*(F.col(f"b{i}") for i in range(bins)))).alias("bin", "k")).select("tile", "bin", r6(F.col("k") / F.col("n")).alias("share"))


@query(f"""WITH {SLOPE}, t AS (SELECT tile, avg(slope) m, avg((slope > 10)::INT) st, CASE WHEN avg(slope) < 8 THEN 'gentle' ELSE 'rolling' END band FROM s GROUP BY tile)
SELECT coalesce(band, 'ALL') AS band, count(*) AS tiles, round(avg(m), 6) AS mean_slope, round(avg(st), 6) AS steep_share FROM t GROUP BY GROUPING SETS ((band), ())""")
def slope_bands_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stencil.slope(raster(spark, sf_dir)).groupBy("tile").agg(F.avg("slope").alias("m"), F.avg((F.col("slope") > 10).cast("double")).alias("st"))
    t = s.withColumn("band", F.when(F.col("m") < 8, "gentle").otherwise("rolling"))
    return t.rollup("band").agg(F.count("*").alias("tiles"), r6(F.avg("m")).alias("mean_slope"), r6(F.avg("st")).alias("steep_share")).select(F.coalesce("band", F.lit("ALL")).alias("band"), "tiles", "mean_slope", "steep_share")


@query(f"""WITH {RASTER}, n AS (SELECT tile, (z - min(z) OVER w) / nullif(max(z) OVER w - min(z) OVER w, 0) h FROM r WINDOW w AS (PARTITION BY tile))
SELECT tile, k::INT AS k, round(avg((coalesce(h, 0.5) >= k / 20.0)::INT), 6) AS share FROM n, (SELECT unnest(range(21)) k) GROUP BY ALL""")
def hypsometric_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster(spark, sf_dir)
    span = cells.groupBy("tile").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    h = cells.join(span, "tile").select("tile", F.coalesce((F.col("z") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.5)).alias("h"))
    wide = h.groupBy("tile").agg(F.array(*(F.avg((F.col("h") >= k / 20.0).cast("double")) for k in range(21))).alias("c"))
    return wide.select("tile", F.posexplode("c").alias("k", "share")).select("tile", "k", r6("share").alias("share"))


@query(f"WITH {RASTER} SELECT tile, round((avg(z) - min(z)) / (max(z) - min(z)), 6) AS hypsometric_integral FROM r GROUP BY tile")
def hypsometric_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = (F.avg("z") - F.min("z")) / F.nullif(F.max("z") - F.min("z"), F.lit(0.0))
    return raster(spark, sf_dir).groupBy("tile").agg(r6(F.coalesce(q, F.lit(0.5))).alias("hypsometric_integral"))


@query(f"""WITH {RASTER}, c AS (SELECT tile, x - avg(x) OVER w u, y - avg(y) OVER w v, z - avg(z) OVER w h FROM r WINDOW w AS (PARTITION BY tile)),
s AS (SELECT tile, sum(u * u) uu, sum(v * v) vv, sum(u * v) uv, sum(u * h) uh, sum(v * h) vh, sum(h * h) hh, count(*) n FROM c GROUP BY tile),
f AS (SELECT *, (uh * vv - vh * uv) / (uu * vv - uv * uv) a, (vh * uu - uh * uv) / (uu * vv - uv * uv) b FROM s)
SELECT tile, round(a, 6) AS slope_x, round(b, 6) AS slope_y, round(sqrt(greatest(hh - a * uh - b * vh, 0) / n), 6) AS residual_rms FROM f""")
def plan_detrend_planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster(spark, sf_dir)
    mean = cells.groupBy("tile").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    c = cells.join(mean, "tile").select("tile", (F.col("x") - F.col("mx")).alias("u"), (F.col("y") - F.col("my")).alias("v"), (F.col("z") - F.col("mz")).alias("h"))
    s = c.groupBy("tile").agg(*(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("uu", "vv", "uv", "uh", "vh", "hh")), F.count("*").alias("n"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    f = s.withColumn("a", (F.col("uh") * F.col("vv") - F.col("vh") * F.col("uv")) / det).withColumn("b", (F.col("vh") * F.col("uu") - F.col("uh") * F.col("uv")) / det)
    return f.select("tile", r6("a").alias("slope_x"), r6("b").alias("slope_y"), r6(F.sqrt(F.greatest(F.col("hh") - F.col("a") * F.col("uh") - F.col("b") * F.col("vh"), F.lit(0.0)) / F.col("n"))).alias("residual_rms"))


LAGS = (1, 2, 3, 5, 8)


@query(f"""WITH {RASTER} SELECT a.tile, l.lag, count(*) AS pairs, round(avg((a.z - b.z) * (a.z - b.z)) / 2, 6) AS gamma FROM (VALUES {", ".join(f"({k})" for k in LAGS)}) l(lag), (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) d(dx, dy), r a, r b
WHERE b.tile = a.tile AND b.x = a.x + d.dx * l.lag AND b.y = a.y + d.dy * l.lag GROUP BY ALL""")
def variogram_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = [(dx * k, dy * k) for k in LAGS for dx, dy in ((0, 1), (1, 0), (1, 1), (1, -1))]
    pairs = stencil.pairs_at(raster(spark, sf_dir), offsets)
    lag = F.element_at(F.array(*map(F.lit, LAGS)), (F.floor(F.col("lag") / 4) + 1).cast("int"))
    return pairs.select("tile", lag.alias("lag"), (F.col("a") - F.col("b")).alias("d")).groupBy("tile", "lag").agg(F.count("*").alias("pairs"), r6(F.avg(F.col("d") * F.col("d")) / 2).alias("gamma"))


@query(f"""WITH {RASTER}, c AS (SELECT tile, x, y, z - avg(z) OVER (PARTITION BY tile) z FROM r), v AS (SELECT tile, avg(z * z) v FROM c GROUP BY tile),
p AS (SELECT a.tile, avg(a.z * b.z) m FROM c a, c b, (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) d(dx, dy) WHERE b.tile = a.tile AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY a.tile)
SELECT tile, round(m / v, 6) AS morans_i FROM p JOIN v USING (tile)""")
def morans_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster(spark, sf_dir)
    mean = cells.groupBy("tile").agg(F.avg("z").alias("m"))
    c = cells.join(mean, "tile").select("tile", "x", "y", (F.col("z") - F.col("m")).alias("z"))
    p = stencil.pairs_at(c, [(0, 1), (1, 0), (1, 1), (1, -1)]).groupBy("tile").agg(F.avg(F.col("a") * F.col("b")).alias("ab"))
    return c.groupBy("tile").agg(F.avg(F.col("z") * F.col("z")).alias("v")).join(p, "tile").select("tile", r6(F.col("ab") / F.col("v")).alias("morans_i"))


@query(f"WITH {SECOND} SELECT tile, count(*) AS n_inner, round(avg(abs(fxx + fyy)), 6) AS mean_abs, round(quantile_cont(abs(fxx + fyy), 0.95), 6) AS p95 FROM d2 GROUP BY tile")
def laplacian_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.abs(F.col("fxx") + F.col("fyy"))
    return stencil.second_differences(raster(spark, sf_dir)).groupBy("tile").agg(F.count("*").alias("n_inner"), r6(F.avg(a)).alias("mean_abs"), r6(F.percentile(a, F.lit(0.95))).alias("p95"))


@query(f"""WITH {SECOND}, k AS (SELECT tile, fx * fx + fy * fy p, fxx * fx * fx + 2 * fxy * fx * fy + fyy * fy * fy a, fxx * fy * fy - 2 * fxy * fx * fy + fyy * fx * fx b FROM d2),
c AS (SELECT tile, CASE WHEN p < 1e-8 THEN 0 ELSE abs(a / (p * power(1 + p, 1.5) + 1e-6)) END prof, CASE WHEN p < 1e-8 THEN 0 ELSE abs(b / (power(p, 1.5) + 1e-6)) END plan FROM k)
SELECT tile, round(avg(prof), 6) AS profile_mean, round(quantile_cont(prof, 0.9), 6) AS profile_p90, round(avg(plan), 6) AS plan_mean, round(quantile_cont(plan, 0.9), 6) AS plan_p90 FROM c GROUP BY tile""")
def curvature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stencil.second_differences(raster(spark, sf_dir))
    fx, fy, fxx, fyy, fxy = (F.col(c) for c in ("fx", "fy", "fxx", "fyy", "fxy"))
    p = fx * fx + fy * fy
    along, across = fxx * fx * fx + 2 * fxy * fx * fy + fyy * fy * fy, fxx * fy * fy - 2 * fxy * fx * fy + fyy * fx * fx
    c = d.select("tile", F.when(p < 1e-8, 0.0).otherwise(F.abs(along / (p * F.pow(1 + p, F.lit(1.5)) + 1e-6))).alias("prof"), F.when(p < 1e-8, 0.0).otherwise(F.abs(across / (F.pow(p, F.lit(1.5)) + 1e-6))).alias("plan"))
    return c.groupBy("tile").agg(r6(F.avg("prof")).alias("profile_mean"), r6(F.percentile("prof", F.lit(0.9))).alias("profile_p90"), r6(F.avg("plan")).alias("plan_mean"), r6(F.percentile("plan", F.lit(0.9))).alias("plan_p90"))


def _window_sql(how: str, radius: int) -> str:
    return f"WITH {RASTER}, a AS (SELECT *, {how}(z) OVER (PARTITION BY tile, y ORDER BY x RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) q FROM r), w AS (SELECT *, {how}(q) OVER (PARTITION BY tile, x ORDER BY y RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) w FROM a)"


@query(f"{_window_sql('avg', 5)} SELECT tile, x, y, round(z - w, 6) AS prominence FROM w")
def box_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.windowed(raster(spark, sf_dir), 5, F.avg).select("tile", "x", "y", r6(F.col("z") - F.col("w")).alias("prominence"))


@query(f"{_window_sql('max', 1)} SELECT tile, x, y, round(w, 6) AS pad_max FROM w")
def window_max_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.windowed(raster(spark, sf_dir), 1, F.max).select("tile", "x", "y", r6("w").alias("pad_max"))


@query(f"""WITH {RASTER}, a AS (SELECT *, max(z) OVER v h, min(z) OVER v l FROM r WINDOW v AS (PARTITION BY tile, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)), w AS (SELECT tile, max(h) OVER v - min(l) OVER v q FROM a WINDOW v AS (PARTITION BY tile, x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT tile, round(avg(q), 6) AS mean_relief, round(stddev_pop(q) / avg(q), 6) AS heterogeneity FROM w GROUP BY tile""")
def local_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster(spark, sf_dir)
    both = stencil.windowed(stencil.windowed(cells, 3, F.max, "hi"), 3, F.min, "lo").select("tile", (F.col("hi") - F.col("lo")).alias("q"))
    return both.groupBy("tile").agg(r6(F.avg("q")).alias("mean_relief"), r6(F.stddev_pop("q") / F.avg("q")).alias("heterogeneity"))


_NB = ", ".join(f"({k}, {dx}, {dy})" for k, (dx, dy) in enumerate(stencil.NEIGHBOURS))
NEAR = f"{RASTER}, nb AS (SELECT a.tile, a.x, a.y, a.z, o.k, b.z nz FROM r a, (VALUES {_NB}) o(k, dx, dy), r b WHERE b.tile = a.tile AND b.x = a.x + o.dx AND b.y = a.y + o.dy)"


@query(f"WITH {NEAR}, e AS (SELECT tile, x, y, bool_and(z > nz) peak, bool_and(z < nz) pit FROM nb GROUP BY ALL HAVING count(*) = 8) SELECT tile, count(*) FILTER (peak) AS peaks, count(*) FILTER (pit) AS pits FROM e GROUP BY tile")
def local_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, nz = F.col("z"), F.col("nz")
    e = stencil.neighbours(raster(spark, sf_dir)).groupBy("tile", "x", "y").agg(F.count("*").alias("n"), F.bool_and(z > nz).alias("peak"), F.bool_and(z < nz).alias("pit")).where("n = 8")
    return e.groupBy("tile").agg(F.count(F.when(F.col("peak"), 1)).alias("peaks"), F.count(F.when(F.col("pit"), 1)).alias("pits"))


@query(f"WITH {NEAR} SELECT tile, x, y FROM nb GROUP BY ALL HAVING count(*) = 8 AND bool_and(nz >= z)")
def pit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.neighbours(raster(spark, sf_dir)).groupBy("tile", "x", "y").agg(F.count("*").alias("n"), F.bool_and(F.col("nz") >= F.col("z")).alias("pit")).where("n = 8 and pit").select("tile", "x", "y")


@query(f"""WITH {NEAR}, f AS (SELECT tile, x, y, k, (z - nz) / CASE WHEN k >= 4 THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END AS fall FROM nb), o AS (SELECT *, row_number() OVER (PARTITION BY tile, x, y ORDER BY fall DESC, k) i FROM f WHERE fall > 0)
SELECT r.tile, r.x, r.y, coalesce(o.k, -1)::INT AS k FROM r LEFT JOIN o ON o.tile = r.tile AND o.x = r.x AND o.y = r.y AND o.i = 1""")
def d8_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.receivers(raster(spark, sf_dir))


#: Blend of the four cells around (px, py) of p(tile, px, py, ...) in SQL, held within 0 to 31, where all cells are present.
BLEND = """q AS (SELECT p.*, least(greatest(px, 0), 31) hx, least(greatest(py, 0), 31) hy FROM p), k AS (SELECT q.*, floor(hx)::INT x0, floor(hy)::INT y0, least(floor(hx) + 1, 31)::INT x1, least(floor(hy) + 1, 31)::INT y1 FROM q),
b AS (SELECT k.*, a.z a, b.z b, c.z c, d.z d FROM k LEFT JOIN r a ON a.tile = k.tile AND a.x = x0 AND a.y = y0 LEFT JOIN r b ON b.tile = k.tile AND b.x = x1 AND b.y = y0 LEFT JOIN r c ON c.tile = k.tile AND c.x = x0 AND c.y = y1 LEFT JOIN r d ON d.tile = k.tile AND d.x = x1 AND d.y = y1),
v AS (SELECT *, (a + (hx - x0) * (b - a)) + (hy - y0) * ((c + (hx - x0) * (d - c)) - (a + (hx - x0) * (b - a))) AS v FROM b)"""


@query(f"""WITH {RASTER}, p AS (SELECT tile, i * 1.7319::DOUBLE - 1.2513::DOUBLE px, j * 2.8837::DOUBLE - 0.5171::DOUBLE py FROM (SELECT DISTINCT tile FROM r), (SELECT unnest(range(20)) i), (SELECT unnest(range(12)) j)), {BLEND}
SELECT tile, round(px, 6) AS px, round(py, 6) AS py, round(v, 6) AS v FROM v""")
def bilinear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places over the edges of the tiles, too."""
    cells = raster(spark, sf_dir)
    places = cells.select("tile").distinct().withColumn("px", F.explode(F.array(*(F.lit(i * 1.7319 - 1.2513) for i in range(20))))).withColumn("py", F.explode(F.array(*(F.lit(j * 2.8837 - 0.5171) for j in range(12)))))
    return stencil.bilinear(cells, places).select("tile", r6("px").alias("px"), r6("py").alias("py"), r6("v").alias("v"))


_WINDOW = [(i, j, 15.5 + (i - 4.5) * 2.6137, 15.5 + (j - 4.5) * 3.8219) for i in range(10) for j in range(10)]


@query(f"""WITH {RASTER}, p AS (SELECT tile, i, j, px, py FROM (SELECT DISTINCT tile FROM r), (VALUES {", ".join(f"({i}, {j}, {x}::DOUBLE, {y}::DOUBLE)" for i, j, x, y in _WINDOW)}) o(i, j, px, py)), {BLEND}
SELECT v.tile, i::INT AS i, j::INT AS j, round(v, 6) AS v, n.z > 27 AS high FROM v LEFT JOIN r n ON n.tile = v.tile AND n.x = floor(hx + 0.5) AND n.y = floor(hy + 0.5)""")
def centred_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window around the middle of each tile at another spacing, over the edges: heights blended, a mask by nearest cell."""
    cells = raster(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(x).alias("px"), F.lit(y).alias("py")) for i, j, x, y in _WINDOW))
    places = cells.select("tile").distinct().select("tile", F.inline(each))
    heights = stencil.bilinear(cells, places).select("tile", "i", "j", r6("v").alias("v"))
    mask = stencil.bilinear(cells, places, "nearest").select("tile", "i", "j", (F.col("v") > 27).alias("high"))
    return heights.join(mask, ["tile", "i", "j"])


@query(f"WITH {RASTER} SELECT tile, (x - 8)::INT AS x, (y - 8)::INT AS y, round(z, 6) AS z FROM r WHERE x BETWEEN 8 AND 23 AND y BETWEEN 8 AND 23")
def window_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).where("x between 8 and 23 and y between 8 and 23").select("tile", (F.col("x") - 8).alias("x"), (F.col("y") - 8).alias("y"), r6("z").alias("z"))


@query(f"WITH {RASTER}, m AS (SELECT tile, z > 25 a, slope > 9 b FROM (WITH {SLOPE} SELECT * FROM s)) SELECT tile, round(avg(a::INT), 6) AS share_a, round(avg(b::INT), 6) AS share_b, round(count(*) FILTER (a AND b) / greatest(count(*) FILTER (a OR b), 1), 6) AS iou FROM m GROUP BY tile")
def mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stencil.slope(raster(spark, sf_dir)).select("tile", (F.col("z") > 25).alias("a"), (F.col("slope") > 9).alias("b"))
    a, b = F.col("a"), F.col("b")
    return m.groupBy("tile").agg(r6(F.avg(a.cast("double"))).alias("share_a"), r6(F.avg(b.cast("double"))).alias("share_b"), r6(F.count(F.when(a & b, 1)) / F.greatest(F.count(F.when(a | b, 1)), F.lit(1))).alias("iou"))


@query(f"WITH {RASTER}, a AS (SELECT tile, x, y FROM r WHERE z > 26), b AS (SELECT tile, x, y FROM r WHERE x < 16) SELECT 'union' AS op, count(*) AS cells FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def mask_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster(spark, sf_dir)
    a, b = cells.where("z > 26").select("tile", "x", "y"), cells.where("x < 16").select("tile", "x", "y")
    count = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("cells"))
    return count(a.union(b).distinct(), "union").union(count(a.intersect(b), "intersect")).union(count(a.exceptAll(b), "except"))


@query(f"WITH {RASTER}, q AS (SELECT tile, x, y, CASE WHEN z > 27 THEN 'high' WHEN (x - 16) * (x - 16) + (y - 16) * (y - 16) < 64 THEN 'disk' WHEN x + y < 20 THEN 'corner' ELSE 'rest' END AS zone FROM r) SELECT tile, zone, count(*) AS cells FROM q GROUP BY ALL")
def zone_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.array(F.when(F.col("z") > 27, F.struct(F.lit(1).alias("p"), F.lit("high").alias("zone"))), F.when(F.pow(F.col("x") - 16, 2) + F.pow(F.col("y") - 16, 2) < 64, F.struct(F.lit(2).alias("p"), F.lit("disk").alias("zone"))), F.when(F.col("x") + F.col("y") < 20, F.struct(F.lit(3).alias("p"), F.lit("corner").alias("zone"))), F.struct(F.lit(9).alias("p"), F.lit("rest").alias("zone")))
    return raster(spark, sf_dir).select("tile", F.array_min(F.array_compact(inside))["zone"].alias("zone")).groupBy("tile", "zone").agg(F.count("*").alias("cells"))


_SEG = ((2.0, 3.0, 20.0, 9.0), (20.0, 9.0, 28.0, 27.0))
_D2 = ", ".join(f"power(x - ({ax} + greatest(0, least(1, ((x - {ax}) * {bx - ax} + (y - {ay}) * {by - ay}) / {(bx - ax) ** 2 + (by - ay) ** 2})) * {bx - ax}), 2) + power(y - ({ay} + greatest(0, least(1, ((x - {ax}) * {bx - ax} + (y - {ay}) * {by - ay}) / {(bx - ax) ** 2 + (by - ay) ** 2})) * {by - ay}), 2)" for ax, ay, bx, by in _SEG)


@query(f"WITH {RASTER} SELECT tile, x, y, round(sqrt(least({_D2})), 6) AS distance FROM r WHERE least({_D2}) <= 9.0")
def corridor_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for ax, ay, bx, by in _SEG:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - ax) * (bx - ax) + (F.col("y") - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        parts.append(F.pow(F.col("x") - (ax + t * (bx - ax)), 2) + F.pow(F.col("y") - (ay + t * (by - ay)), 2))
    return raster(spark, sf_dir).withColumn("d2", F.least(*parts)).where("d2 <= 9.0").select("tile", "x", "y", r6(F.sqrt("d2")).alias("distance"))


# The same hash in SQL, on HUGEINT.
NOISE_SQL = """n0 AS (SELECT s_suppkey AS seed, x, y FROM supplier, (SELECT unnest(range(16)) x), (SELECT unnest(range(16)) y)),
h1 AS (SELECT *, ((xor(seed::BIGINT, 2654435769::BIGINT))::HUGEINT + x::HUGEINT * 2246822507) % 4294967296 AS a FROM n0),
h2 AS (SELECT *, (xor(a::BIGINT, a::BIGINT >> 15)::HUGEINT + y::HUGEINT * 3266489909) % 4294967296 AS b FROM h1),
h3 AS (SELECT *, (xor(b::BIGINT, b::BIGINT >> 13)::HUGEINT * 668265263) % 4294967296 AS c FROM h2),
h AS (SELECT seed::BIGINT AS seed, x::BIGINT AS x, y::BIGINT AS y, xor(c::BIGINT, c::BIGINT >> 16) AS hash FROM h3)"""


def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16 x 16 lattice for each supplier's key as seed; seeds are dealt, as their table is one small file and the lattices are not."""
    side = F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seed"))
    return dealt(seeds, "seed").withColumn("x", F.explode(side)).withColumn("y", F.explode(side))


@query(f"WITH {NOISE_SQL} SELECT seed, x, y, hash FROM h")
def noise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lattice(spark, sf_dir).select("seed", "x", "y", noise.lattice_hash(F.col("x"), F.col("y"), F.col("seed")).alias("hash"))


_G = [f"list_extract([{', '.join(repr(g[i]) for g in noise.GRADIENTS)}], (hash & 7)::INT + 1)" for i in (0, 1)]


@query(f"""WITH {NOISE_SQL.replace("range(16)", "range(6)")}, p AS (SELECT seed, i, j, i * 0.25::DOUBLE AS px, j * 0.25::DOUBLE AS py FROM (SELECT DISTINCT seed FROM h), (SELECT unnest(range(16)) i), (SELECT unnest(range(16)) j)),
q AS (SELECT *, floor(px)::BIGINT x0, floor(py)::BIGINT y0 FROM p),
k AS (SELECT q.*, dx, dy, ({_G[0]} * (px - x0 - dx) + {_G[1]} * (py - y0 - dy)) AS v FROM q, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy), h WHERE h.seed = q.seed AND h.x = x0 + dx AND h.y = y0 + dy),
w AS (SELECT seed, i, j, any_value(px - x0) tx, any_value(py - y0) ty, sum(v) FILTER (dx = 0 AND dy = 0) a, sum(v) FILTER (dx = 1 AND dy = 0) b, sum(v) FILTER (dx = 0 AND dy = 1) c, sum(v) FILTER (dx = 1 AND dy = 1) d FROM k GROUP BY seed, i, j),
e AS (SELECT *, tx * tx * tx * (tx * (tx * 6.0 - 15.0) + 10.0) eu, ty * ty * ty * (ty * (ty * 6.0 - 15.0) + 10.0) ev FROM w)
SELECT seed, i::INT AS i, j::INT AS j, round(((a + eu * (b - a)) + ev * ((c + eu * (d - c)) - (a + eu * (b - a)))) * sqrt(2.0::DOUBLE), 6) + 0.0 AS v FROM e""")
def perlin_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _lattice(spark, sf_dir).select("seed", F.col("x").cast("int").alias("i"), F.col("y").cast("int").alias("j"))
    return at.select("seed", "i", "j", (r6(noise.perlin(F.col("i") * 0.25, F.col("j") * 0.25, F.col("seed"))) + 0.0).alias("v"))


_FBM = """o AS (SELECT unnest(range(3)) o), p AS (SELECT s_suppkey seed, i, j, o, (s_suppkey + o * 2654435769::BIGINT) % 4294967296 AS sd, i * 0.1::DOUBLE * power(2, o) px, j * 0.1::DOUBLE * power(2, o) py, power(0.5, o) amp FROM supplier, o, (SELECT unnest(range(16)) i), (SELECT unnest(range(16)) j)),
q AS (SELECT *, floor(px)::BIGINT x0, floor(py)::BIGINT y0 FROM p), k0 AS (SELECT q.*, dx, dy, x0 + dx cx, y0 + dy cy FROM q, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(dx, dy)),
k1 AS (SELECT *, ((xor(sd::BIGINT, 2654435769::BIGINT))::HUGEINT + cx::HUGEINT * 2246822507) % 4294967296 a FROM k0), k2 AS (SELECT *, (xor(a::BIGINT, a::BIGINT >> 15)::HUGEINT + cy::HUGEINT * 3266489909) % 4294967296 b FROM k1), k3 AS (SELECT *, (xor(b::BIGINT, b::BIGINT >> 13)::HUGEINT * 668265263) % 4294967296 c FROM k2), h AS (SELECT *, xor(c::BIGINT, c::BIGINT >> 16) hash FROM k3)"""


@query(f"""WITH {_FBM}, k AS (SELECT *, ({_G[0]} * (px - x0 - dx) + {_G[1]} * (py - y0 - dy)) v FROM h),
w AS (SELECT seed, i, j, o, any_value(amp) amp, any_value(px - x0) tx, any_value(py - y0) ty, sum(v) FILTER (dx = 0 AND dy = 0) a, sum(v) FILTER (dx = 1 AND dy = 0) b, sum(v) FILTER (dx = 0 AND dy = 1) c, sum(v) FILTER (dx = 1 AND dy = 1) d FROM k GROUP BY seed, i, j, o),
e AS (SELECT *, tx * tx * tx * (tx * (tx * 6.0 - 15.0) + 10.0) eu, ty * ty * ty * (ty * (ty * 6.0 - 15.0) + 10.0) ev FROM w)
SELECT seed, i::INT AS i, j::INT AS j, round(sum(amp * ((a + eu * (b - a)) + ev * ((c + eu * (d - c)) - (a + eu * (b - a))))) * sqrt(2.0::DOUBLE) / 1.75, 6) + 0.0 AS v FROM e GROUP BY ALL""")
def fbm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _lattice(spark, sf_dir).select("seed", F.col("x").cast("int").alias("i"), F.col("y").cast("int").alias("j"))
    return at.select("seed", "i", "j", (r6(noise.fbm(F.col("i") * 0.1, F.col("j") * 0.1, F.col("seed"))) + 0.0).alias("v"))


# Sequential tile algorithms: rows only; tests hold them against analytic surfaces.
def _cells(**grids: np.ndarray) -> pd.DataFrame:
    first = next(iter(grids.values()))
    y, x = np.meshgrid(*map(np.arange, first.shape), indexing="ij")
    return pd.DataFrame({"x": x.ravel().astype(np.int32), "y": y.ravel().astype(np.int32), **{k: v.ravel() for k, v in grids.items()}})


#: Components of cells over 27, neighbours at corners included, named by their first cell in row order.
LABELS = f"""{RASTER}, m AS (SELECT tile, x, y, y * 32 + x id FROM r WHERE z > 27), reach AS (SELECT tile, id s, id t FROM m UNION SELECT reach.tile, reach.s, b.id FROM reach JOIN m a ON a.tile = reach.tile AND a.id = reach.t JOIN m b ON b.tile = a.tile AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1),
lab AS (SELECT tile, s id, min(t) root FROM reach GROUP BY ALL), shape AS (SELECT lab.tile, root, count(*) n, var_pop(x) a, var_pop(y) b, covar_pop(x, y) c FROM lab JOIN m ON m.tile = lab.tile AND m.id = lab.id GROUP BY ALL),
bodies AS (SELECT tile, root, n, CASE WHEN n < 4 THEN 1.0 ELSE sqrt((a + b + sqrt(power(a - b, 2) + 4 * c * c)) / 2 / greatest((a + b - sqrt(power(a - b, 2) + 4 * c * c)) / 2, 1e-9)) END e FROM shape)"""


@query(f"WITH RECURSIVE {LABELS} SELECT tile, dense_rank() OVER (PARTITION BY tile ORDER BY root)::INT AS label, n::INT AS cells, round(least(e, 999), 6) AS elongation FROM bodies")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_tile(raster(spark, sf_dir), lambda z: kernels.component_shapes(kernels.label_components(np.nan_to_num(z, nan=-1.0) > 27)), "label int, cells int, elongation double").withColumn("elongation", r6(F.least("elongation", F.lit(999.0))))


@query(f"""WITH RECURSIVE {LABELS}, k AS (SELECT * FROM bodies WHERE n >= 3), s AS (SELECT tile, count(*) bodies, sum(n) total, max(n) most, sum(n) FILTER (e > 3.5) long, list(n ORDER BY n) sizes FROM k GROUP BY tile)
SELECT tile, bodies, round(most / total::DOUBLE, 6) AS most_share, (sizes[len(sizes) // 2 + 1] * 36.0)::DOUBLE AS median_m2, round(coalesce(long, 0) / total::DOUBLE, 6) AS streamlike FROM s""")
def water_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of three cells or more by tile: the largest's share, the upper median of their areas, the share in long ones."""
    found = kernels.per_tile(raster(spark, sf_dir), lambda z: kernels.component_shapes(kernels.label_components(np.nan_to_num(z, nan=-1.0) > 27)), "label int, cells int, elongation double").where("cells >= 3")
    s = found.groupBy("tile").agg(F.count("*").alias("bodies"), F.sum("cells").alias("total"), F.max("cells").alias("most"), F.sum(F.when(F.col("elongation") > 3.5, F.col("cells")).otherwise(0)).alias("long"), F.sort_array(F.collect_list("cells")).alias("sizes"))
    return s.select("tile", "bodies", r6(F.col("most") / F.col("total")).alias("most_share"), (F.get("sizes", F.floor(F.col("bodies") / 2).cast("int")) * 36.0).alias("median_m2"), r6(F.col("long") / F.col("total")).alias("streamlike"))


@query()
def chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_tile(raster(spark, sf_dir), lambda z: _cells(distance=kernels.chamfer(np.nan_to_num(z, nan=-1.0) > 30)), "x int, y int, distance double")


@query()
def flood_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_tile(raster(spark, sf_dir), lambda z: _cells(filled=kernels.fill_depressions(z)).dropna(), "x int, y int, filled double")


@query()
def flow_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_tile(raster(spark, sf_dir), lambda z: _cells(area=kernels.accumulate(kernels.fill_depressions(z))), "x int, y int, area double")


@query()
def psd_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_tile(raster(spark, sf_dir), lambda z: pd.DataFrame({"beta": [kernels.spectral_slope(z)], "hurst": [(kernels.spectral_slope(z) - 2) / 2]}), "beta double, hurst double")


@query()
def variogram_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fit(z: np.ndarray) -> pd.DataFrame:
        gamma = kernels.semivariogram(kernels.quadratic_residual(z), 12)
        return pd.DataFrame([kernels.fit_exponential(np.arange(1.0, 13.0), gamma)], columns=["nugget", "sill", "reach"])

    return kernels.per_tile(raster(spark, sf_dir), fit, "nugget double, sill double, reach double")


@query()
def diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_tile(raster(spark, sf_dir), lambda z: _cells(z=kernels.diffuse(z)).dropna(), "x int, y int, z double")


@query()
def erosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(z: np.ndarray) -> pd.DataFrame:
        done = erode.erode(z, 6.0, 0.8, 1.0, 0.3)
        return _cells(z=done.z, sediment=done.sediment, area=done.area, lake_depth=done.lake_depth).dropna()

    return kernels.per_tile(raster(spark, sf_dir), run, "x int, y int, z double, sediment double, area double, lake_depth double")


@query()
def erosion_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_tile(raster(spark, sf_dir), lambda z: pd.DataFrame([erode.erode(z, 6.0, 0.8, 1.0, 0.3).mass]), "eroded double, deposited double, exported double")


@query()
def astar_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    def walk(z: np.ndarray) -> pd.DataFrame:
        ok = np.argwhere(~np.isnan(z))
        cost, steps = kernels.shortest_walk(z, tuple(map(int, ok[0])), tuple(map(int, ok[-1])))
        return pd.DataFrame({"cost": [cost], "steps": [steps]})

    return kernels.per_tile(raster(spark, sf_dir), walk, "cost double, steps int")


_Z = "xor({0}, {0} >> {1})"
_MUL = "(({0})::UHUGEINT * {1}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


@query(f"""WITH a AS (SELECT s_suppkey, ((s_suppkey::UHUGEINT * 2654435761 + {noise.SEED_STEP + 3 * noise.CHANNEL_STEP}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT z FROM supplier),
b AS (SELECT s_suppkey, {_MUL.format(_Z.format("z", 30), noise.MIX[0][1])} z FROM a), c AS (SELECT s_suppkey, {_MUL.format(_Z.format("z", 27), noise.MIX[1][1])} z FROM b) SELECT s_suppkey, ({_Z.format("z", 31)} & 4294967295)::BIGINT AS seed FROM c""")
def seed_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", noise.mix_seed(F.col("s_suppkey").cast("long") * 2654435761, 3).alias("seed"))


_SHAPE = terrain.Shape(octaves=3, stretch=1.4, angle=0.6, warp=80.0, ridged=-0.2, power=1.3, patchiness=0.25)


def heights_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _lattice(spark, sf_dir).select("seed", (F.col("x") * 31.25).alias("px"), (F.col("y") * 31.25).alias("py"))
    return terrain.heights(points, _SHAPE).withColumn("tile", F.col("seed").cast("string"))


def worlds_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.hardness(heights_of(spark, sf_dir), "tile", _SHAPE)


@query()
def terrain_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worlds_of(spark, sf_dir).select("tile", "px", "py", r6("z").alias("z"), r6("hardness").alias("hardness"))


@query()
def terrain_eroded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated worlds through the whole erosion pass: heights, hardness, then one Arrow group a world."""
    worlds = worlds_of(spark, sf_dir).select("tile", (F.col("px") / 31.25).cast("int").alias("x"), (F.col("py") / 31.25).cast("int").alias("y"), "z", "hardness")

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        hard = kernels.grid_of(rows.assign(z=rows.hardness))
        done = erode.erode(kernels.grid_of(rows), 31.25, 0.8, 1.0, 0.3, 0.5, hard)
        return _cells(z=done.z, sediment=done.sediment, area=done.area, lake_depth=done.lake_depth).assign(tile=key[0])

    # Small groups are long work here, so adaptive plans should not put many in a task.
    return dealt(worlds, "tile").groupBy("tile").applyInPandas(run, "x int, y int, z double, sediment double, area double, lake_depth double, tile string")
