"""Near lines against plain distances."""

import time

import numpy as np
from pyspark.sql import functions as F

from rasterloom import catalogue
from rasterloom.functions import layouts
from rasterloom.operators import corridors


def test_near_pairs_in_a_dense_field(spark):
    n = 1500
    ends = np.random.default_rng(3).integers(0, 60, (n, 4)) / 2.0
    ends[:5, 2:] = ends[:5, :2]  # points
    ends[5], ends[6] = (0, 0, 10, 0), (10, 0, 20, 0)  # touch
    lines = spark.createDataFrame([("t", k, *map(float, e)) for k, e in enumerate(ends)], "tile string, line long, ax double, ay double, bx double, by double")
    began = time.time()
    found = corridors.near_pairs(lines, 60.0, 45.0)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r.line, r.other): r.gap for r in found.collect()}
    assert len(got) == found.count() and time.time() - began < 60
    i, j = np.triu_indices(n, 1)
    gap = 60.0 * corridors.segment_gaps(ends[i].T, ends[j].T)
    near = gap < 45.0
    assert got == dict(zip(zip(i[near].tolist(), j[near].tolist()), gap[near].tolist()))
    assert got[5, 6] == 0.0


def test_segment_gaps_are_segment_distances(spark):
    p, q = np.random.default_rng(4).integers(0, 6, (2, 4, 400)).astype(float)
    rows = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(p.T, q.T)], "a double, b double, c double, d double, e double, f double, g double, h double")
    want = [r.x for r in rows.select(layouts.segment_distance(tuple(map(F.col, "abcd")), tuple(map(F.col, "efgh"))).alias("x")).collect()]
    assert np.allclose(corridors.segment_gaps(p, q), want, rtol=0, atol=1e-12) and 0.0 in want


def test_violations_find_close_pairs_once(spark):
    for name in ("layout_violations", "sound_lines"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") == 1


def test_crowded_lines_are_those_of_near_pairs(spark):
    n = 700
    ends = np.random.default_rng(6).integers(0, 4000, (n, 4)) / 10.0
    ends[:, 2:] = ends[:, :2] + np.random.default_rng(7).integers(-60, 60, (n, 2)) / 10.0
    ends[:9, 2:] = ends[:9, :2]  # points
    ends[10] = ends[11]
    lines = spark.createDataFrame([(t, k, *map(float, e)) for t in "ab" for k, e in enumerate(ends[: 700 if t == "a" else 300])], "tile string, line long, ax double, ay double, bx double, by double")
    pairs = corridors.near_pairs(lines, 60.0, 200.0).collect()
    got = [(r.tile, r.line) for r in corridors.crowded(lines, 60.0, 200.0).collect()]
    assert sorted(got) == sorted({(r.tile, x) for r in pairs for x in (r.line, r.other)}) and 100 < len(got) < 900


def test_crowded_lines_of_a_dense_field_take_no_pairs(spark, monkeypatch):
    # 30,000 lines make some 130 million near pairs.
    import pandas as pd

    met = []
    gaps = corridors.segment_gaps
    monkeypatch.setattr(corridors, "segment_gaps", lambda p, q: met.append(p.shape[1]) or gaps(p, q))
    at = np.random.default_rng(8).integers(0, 60, (30000, 4)) / 2.0
    rows = pd.DataFrame(at, columns=["ax", "ay", "bx", "by"]).assign(tile="t", line=np.arange(30000))
    found = pd.concat(corridors._square_crowd(rows, 60.0, 45.0))
    assert len(found) == 30000 and sum(met) < 10_000_000


def test_violations_read_the_cells_once(spark):
    for name in ("layout_violations", "sound_lines"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_quantity" not in plan and "other" not in plan
