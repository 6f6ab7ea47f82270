"""Fitted models against NumPy and planted structure; ranks and draws against plain sorts."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import models, population, ranking

RNG = np.random.default_rng(5)


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_components_match_numpy(spark):
    a = RNG.normal(size=(300, 3)) @ np.array([[2.0, 1.0, 0.0], [0.0, 1.0, 0.5], [0.0, 0.0, 0.3]])
    a[0, 1] = np.nan
    rows = frame(spark, a=a[:, 0], b=a[:, 1], c=a[:, 2], flat=np.ones(300), none=np.full(300, np.nan))
    got = models.principal_components(rows, ["a", "b", "c", "flat", "none"]).toPandas()
    z = (a - np.nanmean(a, 0)) / np.nanstd(a, 0)
    z = np.nan_to_num(z)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert got.drop_duplicates("component").explained.to_numpy() == pytest.approx(values / values.sum(), rel=1e-9)
    assert set(got.feature) == {"a", "b", "c"}


def test_bic_finds_two_clusters(spark):
    x = np.concatenate([RNG.normal(-4, 1, 200), RNG.normal(4, 1, 200)])
    got = models.mixture_bic(frame(spark, x=x, y=RNG.normal(size=400)), ["x", "y"], range(1, 4)).toPandas()
    assert got.k[got.bic.argmin()] == 2


def test_density_ratio_follows_the_shift(spark):
    real = frame(spark, k=np.arange(2000), x=RNG.normal(1, 1, 2000))
    synthetic = frame(spark, k=np.arange(2000, 4000), x=RNG.normal(0, 1, 2000))
    got = models.density_ratio(real, synthetic, ["x"], "k").join(synthetic, "k").toPandas()
    assert len(got) == 2000
    assert np.corrcoef(np.log(got.r), got.x - 0.5)[0, 1] > 0.99
    assert np.polyfit(got.x, np.log(got.r), 1)[0] == pytest.approx(1, abs=0.15)


def test_emulator_fits_a_step(spark):
    x = RNG.uniform(size=600)
    got = models.emulator_r2(frame(spark, k=np.arange(600), x=x, y=np.where(x > 0.5, 1.0, 0.0)), ["x"], "y", "k", 3).toPandas()
    assert got.n.sum() == 600 and (got.r2 > 0.9).all()


def test_total_effects_of_a_sum(spark):
    a, b = RNG.normal(size=(2, 20000))
    c, d = RNG.normal(size=(2, 20000))
    got = models.total_effects(frame(spark, f=2 * a + b, p=2 * c + b, q=2 * a + d), "f", ["p", "q"]).toPandas().set_index("knob").total_effect
    assert got["p"] == pytest.approx(0.8, abs=0.05) and got["q"] == pytest.approx(0.2, abs=0.02)


def test_hash_order_is_the_sorted_order(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    got = ranking.hash_order(rows, F.col("k")).toPandas()
    want = sorted(got.k, key=lambda k: hashlib.md5(k.encode()).hexdigest())
    assert got.sort_values("rank").k.tolist() == want and set(got.n) == {5000}


def test_draws_follow_the_weights(spark):
    weights = frame(spark, k=np.arange(5000), w=(np.arange(5000) % 3).astype(float))
    cdf = ranking.cumulative(weights, "k", "w")
    top = cdf.agg(F.max("high")).first()[0]
    assert top == pytest.approx(1.0)
    units = frame(spark, u=np.concatenate([[0.0], RNG.uniform(size=2000)]))
    got = ranking.draw(units, "u", cdf, "k").toPandas()
    edges = np.cumsum(np.arange(5000) % 3) / (np.arange(5000) % 3).sum()
    assert len(got) == 2001
    assert (got.k == np.searchsorted(edges, got.u, side="right")).mean() > 0.999


def test_empirical_distributions_by_slices(spark):
    a, b = RNG.normal(size=900).round(1), RNG.normal(0.3, 1, 700).round(1)
    rows = lambda v: frame(spark, g=np.where(np.arange(len(v)) % 2, "x", "y"), v=v)
    energy = population.energy_distance(rows(a), rows(b), "v").first()[0]
    pair = lambda p, q: np.abs(p[:, None] - q[None, :]).mean()
    assert energy == pytest.approx(2 * pair(a, b) - pair(a, a) - pair(b, b))
    ks = {r.g: r.ks for r in population.ks_two_sample(rows(a), rows(b), "g", "v").collect()}
    for g, odd in (("x", 1), ("y", 0)):
        p, q = np.sort(a[odd::2]), np.sort(b[odd::2])
        at = np.union1d(p, q)
        assert ks[g] == pytest.approx(np.abs(np.searchsorted(p, at, "right") / len(p) - np.searchsorted(q, at, "right") / len(q)).max())


def test_sobol_points_fill_evenly(spark):
    n = 256
    got = np.array([list(r) for r in spark.range(n).select(*(ranking.sobol(F.col("id"), d) for d in range(6))).collect()])
    # Every dimension has one point in each of n slices, every pair of the first two one in each cell of a 16 x 16 grid.
    assert all(sorted((got[:, d] * n).astype(int)) == list(range(n)) for d in range(6))
    cells = (got[:, :2] * 16).astype(int)
    assert len({tuple(c) for c in cells}) == n
    assert ranking.direction_numbers(1, 4) == [8, 12, 10, 15]


def test_ward_equals_brute_force(spark):
    x = RNG.normal(size=(12, 2)) * [1, 3]
    got = models.ward(frame(spark, k=np.arange(12), a=x[:, 0], b=x[:, 1]), "k", ["a", "b"]).toPandas()
    z = (x - x.mean(0)) / x.std(0)
    clusters = {i: [i] for i in range(12)}
    for r in got.sort_values("step").itertuples():
        cost = lambda p, q: 2 * len(p) * len(q) / (len(p) + len(q)) * ((z[p].mean(0) - z[q].mean(0)) ** 2).sum()
        best = min(cost(clusters[i], clusters[j]) for i in clusters for j in clusters if i < j)
        assert r.height == pytest.approx(np.sqrt(best)) and r.height == pytest.approx(np.sqrt(cost(clusters[r.a], clusters[r.b])))
        clusters[12 + r.step] = clusters.pop(r.a) + clusters.pop(r.b)
        assert r.size == len(clusters[12 + r.step])


def test_hull_coverage_of_planted_points(spark):
    a = RNG.uniform(-1, 1, size=(3000, 2))
    b = np.concatenate([RNG.uniform(-0.4, 0.4, size=(30, 2)), np.full((10, 2), 5.0) + RNG.normal(size=(10, 2))])
    got = models.hull_coverage(frame(spark, x=a[:, 0], y=a[:, 1]), frame(spark, x=b[:, 0], y=b[:, 1]), ["x", "y"]).first()
    assert (got.real, got.inside) == (40, 30)
