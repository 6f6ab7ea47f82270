"""Nearest segments against all distances."""

import time

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import spatial

SCHEMA = "line long, i int, ax double, ay double, bx double, by double"


def nearest(places, ends, reach):
    """(line or -1, distance) of each place by all pairs; lines ascend."""
    gap = np.array([spatial._gaps(x, y, ends) for x, y in places.T])
    gap = np.floor(gap * 1e6 + 0.5) / 1e6
    first = gap.argmin(axis=1)
    least = gap[np.arange(len(first)), first]
    return np.where(least <= reach, first, -1), least


def test_many_points_among_many_segments(spark):
    # Pairs within reach are some 900 million, more than can pass as rows.
    rng = np.random.default_rng(7)
    places = np.concatenate([rng.integers(0, 40, (2, 1000)) / 10.0, rng.uniform(-1, 5, (2, 1000))], axis=1)
    ends = np.concatenate([rng.integers(0, 40, (4, 1200)) / 10.0, rng.uniform(0, 4, (4, 1200))], axis=1)
    ends[2:, :50] = ends[:2, :50]  # points
    lines = spark.createDataFrame([(k // 3, k % 3, *map(float, e)) for k, e in enumerate(ends.T)], SCHEMA)
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(places.T)], "place long, px double, py double")
    many = points.crossJoin(spark.range(200).withColumnRenamed("id", "copy")).withColumn("point", F.col("place") + 2000 * F.col("copy"))
    began = time.time()
    got = {(r.place, r.line, r.i, r.distance): r.n for r in spatial.nearest_segment(many, "point", lines, 2.0).groupBy((F.col("point") % 2000).alias("place"), "line", "i", "distance").agg(F.count("*").alias("n")).collect()}
    assert time.time() - began < 40
    best, least = nearest(places, ends, 2.0)
    assert got == {(k, b // 3, b % 3, d): 200 for k, (b, d) in enumerate(zip(best.tolist(), least.tolist())) if b >= 0}


def test_sparse_far_and_missing_ones(spark):
    rng = np.random.default_rng(8)
    places, ends = rng.uniform(-300, 300, (2, 500)), rng.uniform(-300, 300, (4, 60))
    ends[:2] = ends[2:] + rng.uniform(-20, 20, (2, 60))
    lines = spark.createDataFrame([*((k, 1, *map(float, e)) for k, e in enumerate(ends.T)), (90, 1, 0.0, None, 1.0, 1.0), (91, 1, 0.0, float("nan"), 1.0, 1.0), (92, 1, 0.0, 0.0, float("inf"), 1.0)], SCHEMA)
    points = spark.createDataFrame([*((k, *map(float, p)) for k, p in enumerate(places.T)), (900, None, 1.0), (901, float("nan"), 1.0)], "point long, px double, py double")
    best, least = nearest(places, ends, 12.0)
    got = {(r.point, r.line, r.distance) for r in spatial.nearest_segment(points, "point", lines, 12.0).collect()}
    assert got == {(k, b, d) for k, (b, d) in enumerate(zip(best.tolist(), least.tolist())) if b >= 0} and 0 < len(got) < 500
    assert not spatial.nearest_segment(points.limit(0), "point", lines, 12.0).collect()


def test_halving_reaches_the_first_on_ties():
    rng = np.random.default_rng(9)
    places, ends = rng.integers(0, 30, (2, 900)).astype(float), rng.integers(0, 30, (4, 700)).astype(float)
    best, least = spatial.first_nearest(places, ends, 1.0)
    want, gaps = nearest(places, ends, 1.0)
    assert (best == want).all() and (least[best >= 0] == gaps[want >= 0]).all()
