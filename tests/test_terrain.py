"""Seed mixing and noise terrain against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import catalogue
from rasterloom.functions import noise
from rasterloom.operators import terrain

WORD = (1 << 64) - 1


def mixed(seed, channel):
    z = (seed + noise.SEED_STEP + channel * noise.CHANNEL_STEP) & WORD
    for shift, by in noise.MIX:
        z = (z ^ (z >> shift)) * (by or 1) & WORD
    return z & 0xFFFFFFFF


def test_mix_seed(spark):
    seeds = [0, 1, 77, -1, -(1 << 63), (1 << 63) - 1, 0x0123456789ABCDEF]
    rows = spark.createDataFrame([(s,) for s in seeds], "seed long")
    got = rows.select("seed", *(noise.mix_seed(F.col("seed"), c).alias(f"c{c}") for c in (0, 1, 8))).collect()
    for r in got:
        assert [r.c0, r.c1, r.c8] == [mixed(r.seed & WORD, c) for c in (0, 1, 8)]


def points(spark):
    return spark.range(40).select(F.lit(5).cast("long").alias("seed"), (F.col("id") * 37.5).alias("px"), (F.col("id") * 21.25 - 300).alias("py"))


def test_plain_shape_is_octave_noise(spark):
    shape = terrain.Shape(amplitude=3.0, period=200.0, octaves=2)
    z = [r.z for r in terrain.heights(points(spark), shape).orderBy("px").collect()]
    want = points(spark).select("px", (3.0 * noise.fbm(F.col("px") / 200.0, F.col("py") / 200.0, F.lit(mixed(5, 0)), 2)).alias("z")).orderBy("px").collect()
    assert z == pytest.approx([r.z for r in want])


def test_every_knob_matters_and_is_finite(spark):
    plain = terrain.heights(points(spark), terrain.Shape(octaves=2)).orderBy("px").collect()
    for knob in ({"stretch": 2.0, "angle": 0.5}, {"warp": 60.0}, {"ridged": 0.4}, {"ridged": -0.4}, {"power": 2.0}, {"power": 0.5}, {"patchiness": 0.3}):
        got = terrain.heights(points(spark), terrain.Shape(octaves=2, **knob)).orderBy("px").collect()
        assert any(a.z != b.z for a, b in zip(plain, got, strict=True)), knob
        assert all(math.isfinite(r.z) for r in got)


@pytest.mark.parametrize("power", [0.5, 1.0, 2.0])
def test_redistribution_keeps_the_median(power):
    middle, top, bottom = terrain.redistributed(np.array([0.0, 1.0, -1.0]), power)
    assert middle == pytest.approx(0) and top - bottom == pytest.approx(2)


def test_batches_hash_like_columns(spark):
    x, y = np.arange(-20, 20), np.arange(40) * 7 - 90
    rows = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x long, y long")
    got = [r[0] for r in rows.select(noise.lattice_hash(F.col("x"), F.col("y"), F.lit(12345))).collect()]
    assert got == terrain.lattice_hash(x, y, np.full(40, 12345, np.uint32)).tolist()
    seeds = np.array([0, 1, -1, -(1 << 63)])
    assert terrain.mix_seed(seeds, 8).tolist() == [mixed(int(s) & WORD, 8) for s in seeds]


def test_hardness_is_bounded(spark):
    cells = terrain.heights(points(spark), terrain.Shape(octaves=2)).withColumn("tile", F.lit("a"))
    got = [r.hardness for r in terrain.hardness(cells, "tile", terrain.Shape()).collect()]
    assert len(got) == 40 and all(-1 <= h <= 1 for h in got) and len(set(got)) > 30


def test_hardness_sends_no_cells_to_the_driver(spark):
    # Rows exploded from a small table look few to Spark, so a join would broadcast them.
    side = F.sequence(F.lit(0), F.lit(15))
    cells = spark.range(8).select(F.col("id").alias("seed"), F.explode(side).alias("i")).select("seed", F.explode(side).alias("j"), "i")
    placed = cells.select("seed", (F.col("i") * 31.25).alias("px"), (F.col("j") * 31.25).alias("py"), (F.col("i") * 3.0 + F.col("seed")).alias("z"))
    hard = terrain.hardness(placed, "seed", terrain.Shape())
    assert "Broadcast" not in hard._jdf.queryExecution().toString()
    got = hard.collect()
    assert len(got) == 8 * 256 and all(-1 <= r.hardness <= 1 for r in got)
    # Each height stands 16 times in a world, so the 2nd and 98th percentiles are the least and greatest: 0 and 45 m.
    thick = 45 / 4
    r = next(r for r in got if r.seed == 0 and r.px == 93.75 and r.py == 62.5)
    x, y, seed = np.array([93.75]), np.array([62.5]), np.array([0])
    want = 0.6 * terrain.fbm(x / terrain.HARD_PERIOD, y / terrain.HARD_PERIOD, terrain.mix_seed(seed, terrain.HARD), 2) + 0.4 * terrain.perlin(np.array([r.z / thick]), np.array([0.5]), terrain.mix_seed(seed, terrain.STRATA))
    assert r.hardness == pytest.approx(want[0])


def test_eroded_worlds_stay_spread(spark):
    plan = catalogue.QUERIES["terrain_eroded"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and plan.count("REPARTITION_BY_NUM") == 2
