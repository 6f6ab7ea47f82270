"""Queries that write the raster in a packed format and read it back."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kernels import grid_of, per_tile
from ..sources import packed
from ..sources.tables import RASTER, raster, scratch

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"WITH {RASTER} SELECT tile, x, y, round(z::FLOAT::DOUBLE, 6) AS z, z > 30 AS water FROM r")
def grid_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(packed.GridFiles)

    def north_first(z: np.ndarray) -> pd.DataFrame:
        z = z[::-1]
        return pd.DataFrame({"ny": [z.shape[0]], "nx": [z.shape[1]], "cell": [6.0], "z": [z.ravel().astype(np.float32)], "water": [np.nan_to_num(z).ravel() > 30]})

    grids = per_tile(raster(spark, sf_dir), north_first, "ny int, nx int, cell float, z array<float>, water array<boolean>")
    folder = f"{scratch(spark)}/grids-{uuid.uuid4().hex}"
    grids.withColumnRenamed("tile", "name").write.format("gridfile").option("path", folder).mode("append").save()
    cells = spark.read.format("gridfile").option("path", folder).load().select(F.col("name").alias("tile"), "ny", "nx", F.posexplode(F.arrays_zip("z", "water")).alias("i", "c"))
    y = F.col("ny") - 1 - F.floor(F.col("i") / F.col("nx")).cast("int")
    return cells.select("tile", (F.col("i") % F.col("nx")).alias("x"), y.alias("y"), F.round(F.col("c.z").cast("double"), 6).alias("z"), F.col("c.water").alias("water")).where("not isnan(z)")


def _record(tile: str, rows: pd.DataFrame) -> dict:
    z = grid_of(rows)
    z = np.pad(z, [(0, 32 - z.shape[0]), (0, 32 - z.shape[1])], constant_values=np.nan)
    low = float(np.nanmin(z))
    return {"key": tile, "label": tile, "arch": "", "group": packed.band_of(float(np.nanmax(z)) - low), "wm": 192.0, "hm": 192.0, "emin": low, "emax": float(np.nanmax(z)), "waterpct": 0.0, "treepct": 0.0, "bbox": [0.0] * 4, "z": np.nan_to_num(z, nan=low), "water": np.nan_to_num(z) > 30, "trees": np.isnan(z), "holes": [(1, None, [(0.0, 0.0), (1.0, 2.0)])]}


@query(f"""WITH {RASTER}, l AS (SELECT tile, min(z) lo, max(z) - min(z) AS span FROM r GROUP BY tile)
SELECT tile, x, y, round((lo + floor((z - lo) * 10 + 0.5) / 10)::FLOAT::DOUBLE, 6) AS z, z > 30 AS water, CASE WHEN span < 30 THEN 'lowland' WHEN span < 80 THEN 'rolling' ELSE 'mountain' END AS band FROM r JOIN l USING (tile)""")
def survey_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def through(key, rows: pd.DataFrame) -> pd.DataFrame:
        (r,) = packed.decode_survey(packed.encode_survey([_record(key[0], rows)], 32), 32)
        y, x = np.indices((32, 32))
        out = pd.DataFrame({"tile": r["key"], "x": x.ravel(), "y": y.ravel(), "z": r["z"].astype(float).round(6), "water": r["water"], "band": packed.BANDS[r["group"]]})
        return out[~r["trees"]]

    return raster(spark, sf_dir).groupBy("tile").applyInPandas(through, "tile string, x int, y int, z double, water boolean, band string")


@query()
def survey_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    def mark(key, rows: pd.DataFrame) -> pd.DataFrame:
        r = _record(key[0], rows)
        return pd.DataFrame({"tile": [key[0]], "fingerprint": [f"{packed.fingerprint([(key[0], packed.to_decimetres(r['z'], r['emin']).tobytes())]):016x}"]})

    return raster(spark, sf_dir).groupBy("tile").applyInPandas(mark, "tile string, fingerprint string")


@query(f"WITH {RASTER} SELECT tile AS key, round(min(z), 6) AS emin, round(max(z), 6) AS emax, CASE WHEN max(z) - min(z) < 30 THEN 'lowland' WHEN max(z) - min(z) < 80 THEN 'rolling' ELSE 'mountain' END AS band, 1::BIGINT AS lines FROM r GROUP BY tile")
def embedded_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster(spark, sf_dir).groupBy("tile").agg(F.min("z").alias("emin"), F.max("z").alias("emax"))
    holes = F.array(F.struct(F.lit(1).alias("ref"), F.array(F.array(F.lit(0.0), F.lit(1.0))).alias("pts")))
    records = cells.select(F.to_json(F.create_map("tile", F.struct("emin", "emax", holes.alias("holes")))).alias("json"))
    pages = records.select(F.concat(F.lit("<html><script>window.COURSES="), "json", F.lit(";\n</script></html>")).alias("html"))
    found = packed.embedded_records(pages)
    return found.select("key", F.round("emin", 6).alias("emin"), F.round("emax", 6).alias("emax"), "band", F.size("holes").cast("long").alias("lines"))
