"""Queries on channels, basins, wetlands, outlines and sites by tile."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels, water
from ..operators.landforms import fill_nearest
from ..sources.tables import polylines, raster, table

QUERIES: dict = {}
#: Most are sequential tile algorithms without SQL; tests hold them against brute force and drawn shapes.
ORACLES: dict = {}
CELL = 6.0


def query(f):
    QUERIES[f.__name__] = f
    return f


def _places(z: np.ndarray, cells: np.ndarray) -> pd.DataFrame:
    y, x = np.divmod(np.asarray(cells, int), z.shape[1])
    return pd.DataFrame({"rank": np.arange(1, len(x) + 1, dtype=np.int32), "x": x.astype(np.int32), "y": y.astype(np.int32)})


@query
def stream_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_tile(raster(spark, sf_dir), lambda z: water.stream_table(fill_nearest(z), CELL, 400.0, 400.0), "stream int, cells int, length double, width double, area double")


@query
def wetland_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_tile(raster(spark, sf_dir), lambda z: _places(z, water.wetlands(z, CELL, 400.0, 0.6, 40)), "rank int, x int, y int")


@query
def lake_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_tile(raster(spark, sf_dir), lambda z: water.basins(fill_nearest(z), CELL, 0.5, 2), "basin int, cells int, depth double, volume double, surface double")


@query
def signed_distance_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    def field(z: np.ndarray) -> pd.DataFrame:
        d = water.signed_distance(np.nan_to_num(z) > 28, CELL)
        return _places(z, np.arange(z.size)).drop(columns="rank").assign(distance=d.ravel())

    return kernels.per_tile(raster(spark, sf_dir), field, "x int, y int, distance double")


@query
def dry_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_tile(raster(spark, sf_dir), lambda z: pd.DataFrame({"cells": [water.largest_component(z <= 28)], "dry": [int((z <= 28).sum())]}), "cells int, dry int")


@query
def thinned_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.per_tile(raster(spark, sf_dir), lambda z: _places(z, water.thinned(z, 4.0, 20)), "rank int, x int, y int")


@query
def hull_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def clip(z: np.ndarray) -> pd.DataFrame:
        y, x = np.nonzero(np.nan_to_num(z) > np.nanpercentile(z, 99))
        inside = water.hull_mask(np.stack([x, y], 1), z.shape, 2)
        return _places(z, np.flatnonzero(inside)).drop(columns="rank")

    return kernels.per_tile(raster(spark, sf_dir), clip, "x int, y int")


@query
def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of an integer segment for each supplier."""
    part = lambda by, of: (F.col("s_suppkey") * by % of).cast("int")
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", part(7, 31).alias("x0"), part(11, 29).alias("y0"), part(13, 32).alias("x1"), part(17, 27).alias("y1"))

    def run(batches):
        for rows in batches:
            found = [(k, i, x, y) for k, *ends in rows.itertuples(index=False) for i, (x, y) in enumerate(water.line_cells(*ends))]
            yield pd.DataFrame(found, columns=["s_suppkey", "i", "x", "y"])

    return lines.mapInPandas(run, "s_suppkey long, i int, x int, y int")


ORACLES["line_cells"] = """WITH RECURSIVE s AS (SELECT s_suppkey, (s_suppkey * 7 % 31)::INT x0, (s_suppkey * 11 % 29)::INT y0, (s_suppkey * 13 % 32)::INT x1, (s_suppkey * 17 % 27)::INT y1 FROM supplier),
c AS (SELECT s_suppkey, 0 AS i, x0 AS x, y0 AS y, x1, y1, abs(x1 - x0) - abs(y1 - y0) AS e, abs(x1 - x0) dx, abs(y1 - y0) dy, CASE WHEN x1 > x0 THEN 1 ELSE -1 END sx, CASE WHEN y1 > y0 THEN 1 ELSE -1 END sy FROM s
UNION ALL SELECT s_suppkey, i + 1, CASE WHEN 2 * e >= -dy THEN x + sx ELSE x END, CASE WHEN 2 * e <= dx THEN y + sy ELSE y END, x1, y1, e - CASE WHEN 2 * e >= -dy THEN dy ELSE 0 END + CASE WHEN 2 * e <= dx THEN dx ELSE 0 END, dx, dy, sx, sy FROM c WHERE x <> x1 OR y <> y1)
SELECT s_suppkey, i, x, y FROM c"""


@query
def chained_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of 18 out of each user's lines from vertex to vertex, which are numbered 1 to 24 over again."""
    both = polylines(spark, sf_dir).select("line", "i", "px", "py")

    def rounds(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        at = rows[["px", "py"]].to_numpy()
        number = (np.arange(len(at) - 1) * 5 % 24 + 1).astype(float)
        order = water.chained(at[:-1], at[1:], number, at.mean(0)) if len(at) > 1 else np.zeros(0, int)
        return pd.DataFrame({"line": key[0], "place": np.arange(1, len(order) + 1, dtype=np.int32), "i": rows.i.to_numpy()[order], "number": number[order].astype(np.int32)})

    return both.groupBy("line").applyInPandas(rounds, "line long, place int, i int, number int")
