"""Fitted models on feature tables: components, mixtures, density ratios, emulators, sensitivity.

Features are standardised by population deviation; missing values (null or NaN) stand at the
mean, and features that are missing everywhere or do not vary are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Directions whose farthest points make a hull.
DIRECTIONS = 180


def scored(rows: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with z-scored features, and those that vary."""
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in features}
    s = rows.agg(*(F.avg(known[c]).alias(f"m_{c}") for c in features), *(F.stddev_pop(known[c]).alias(f"s_{c}") for c in features)).first()
    kept = [c for c in features if s[f"s_{c}"]]
    return rows.withColumns({c: F.coalesce((known[c] - s[f"m_{c}"]) / s[f"s_{c}"], F.lit(0.0)) for c in kept}), kept


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def principal_components(rows: DataFrame, features: list[str]) -> DataFrame:
    """(component, explained, cumulative, feature, loading), the largest loading of a component positive."""
    import numpy as np
    from pyspark.ml.feature import PCA

    z, kept = scored(rows, features)
    columns = "component int, explained double, cumulative double, feature string, loading double"
    if not kept:
        return rows.sparkSession.createDataFrame([], columns)
    fitted = PCA(k=len(kept), inputCol="features", outputCol="pc").fit(assembled(z, kept))
    axes, share = fitted.pc.toArray(), fitted.explainedVariance.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(kept))])
    total = np.cumsum(share)
    out = [(j, float(share[j]), float(total[j]), kept[i], float(axes[i, j])) for j in range(len(kept)) for i in range(len(kept))]
    return rows.sparkSession.createDataFrame(out, columns)


def component_scores(rows: DataFrame, features: list[str], key: str, most: int) -> DataFrame:
    """(key, pc0, pc1, ...): places on the first components, `most` columns; those that there are none of are 0."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    z, kept = scored(rows, features)
    have = min(most, len(kept))
    if not have:
        return rows.select(key, *(F.lit(0.0).alias(f"pc{i}") for i in range(most)))
    out = PCA(k=have, inputCol="features", outputCol="pc").fit(assembled(z, kept)).transform(assembled(z, kept)).select(key, vector_to_array("pc").alias("pc"))
    return out.select(key, *((F.col("pc")[i] if i < have else F.lit(0.0)).alias(f"pc{i}") for i in range(most)))


def hull_coverage(synthetic: DataFrame, real: DataFrame, features: list[str]) -> DataFrame:
    """(real, inside, share): how many real rows lie in the hull of the synthetic ones, on two components of both.

    The hull is of each direction's farthest points, DIRECTIONS of them a bounded set that reaches the driver.
    """
    import numpy as np

    from .water import convex_hull

    both = synthetic.select(*features, F.lit(0).alias("real")).unionByName(real.select(*features, F.lit(1).alias("real")))
    scores = component_scores(both, features, "real", 2)
    turns = [2 * math.pi * i / DIRECTIONS for i in range(DIRECTIONS)]
    far = scores.where("real = 0").agg(*(F.max_by(F.struct("pc0", "pc1"), F.col("pc0") * math.cos(t) + F.col("pc1") * math.sin(t)) for t in turns)).first()
    corners = convex_hull(np.array([(p[0], p[1]) for p in far if p is not None]).reshape(-1, 2))
    inside = F.lit(len(corners) > 2)
    for (ax, ay), (bx, by) in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        inside = inside & (float(bx - ax) * (F.col("pc1") - float(ay)) - float(by - ay) * (F.col("pc0") - float(ax)) >= -1e-9)
    found = scores.where("real = 1").agg(F.count("*").alias("real"), F.count(F.when(inside, 1)).alias("inside"))
    return found.select("real", "inside", (F.col("inside") / F.nullif(F.col("real"), F.lit(0))).alias("share"))


def ward(rows: DataFrame, key: str, features: list[str], most: int = 4096) -> DataFrame:
    """(step, a, b, height, size): merges of the rows by Ward's distance, clusters numbered on from the rows in key order.

    The rows are a table of groups: more than `most` raise, as their distances wouldn't fit one task.
    """
    import numpy as np

    z, kept = scored(rows, features)
    held = z.orderBy(key).limit(most + 1).select(*kept).collect()
    if len(held) > most:
        raise ValueError("too many rows for a tree; group them first")
    x, n = np.array([list(r) for r in held], float).reshape(len(held), len(kept)), len(held)
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(distance, np.inf)
    name, size, out = list(range(n)), np.ones(n), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        d = np.where(alive[:, None] & alive[None], distance, np.inf)
        i, j = np.unravel_index(int(np.argmin(d)), d.shape)
        i, j = min(i, j), max(i, j)
        low, high = sorted((name[i], name[j]))
        out.append((step, low, high, float(np.sqrt(distance[i, j])), int(size[i] + size[j])))
        # Lance and Williams' update.
        merged = ((size + size[i]) * distance[i] + (size + size[j]) * distance[j] - size * distance[i, j]) / (size + size[i] + size[j])
        distance[i], distance[:, i] = merged, merged
        distance[i, i] = np.inf
        size[i] += size[j]
        name[i], alive[j] = n + step, False
    return rows.sparkSession.createDataFrame(out, "step int, a int, b int, height double, size int")


def mixture_bic(rows: DataFrame, features: list[str], sizes: Iterable[int], seed: int = 7, starts: int = 5) -> DataFrame:
    """(k, log_likelihood, bic, silhouette) of full-covariance Gaussian mixtures, the best of several starts.

    A start can end in a poor optimum, so one is not enough. One component has a closed form and no
    silhouette; the others' is of squared distances, from sums by cluster.
    """
    import numpy as np
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.evaluation import ClusteringEvaluator

    z, kept = scored(rows, features)
    data, d, out = assembled(z, kept).select("features").cache(), len(kept), []
    n = data.count()
    for k in sizes:
        silhouette = None
        if k == 1:
            flat = z.agg(*(F.covar_pop(a, b) for a in kept for b in kept)).first()
            likelihood = -n / 2 * (d * math.log(2 * math.pi) + d + np.linalg.slogdet(np.array(flat, float).reshape(d, d))[1])
        else:
            best = max((GaussianMixture(k=k, seed=seed + i, maxIter=100, tol=1e-3).fit(data) for i in range(starts)), key=lambda m: m.summary.logLikelihood)
            likelihood, told = best.summary.logLikelihood, best.transform(data)
            if told.select("prediction").distinct().limit(2).count() > 1:
                silhouette = float(ClusteringEvaluator().evaluate(told))
        free = k - 1 + k * d + k * d * (d + 1) // 2
        out.append((k, float(likelihood), float(free * math.log(n) - 2 * likelihood), silhouette))
    data.unpersist()
    return rows.sparkSession.createDataFrame(out, "k int, log_likelihood double, bic double, silhouette double")


def fold_of(key: str, folds: int):
    """A stable fold of a row by its key's hash."""
    return F.pmod(F.xxhash64(key), F.lit(folds))


def density_ratio(real: DataFrame, synthetic: DataFrame, features: list[str], key: str, folds: int = 4) -> DataFrame:
    """(key, r) of each synthetic row: how much denser the real rows are there.

    A balanced logistic classifier scores rows out of fold; a second one of its score alone, over
    all folds (Platt), gives odds of equal classes, which are the ratio.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    both = real.select(key, *features, F.lit(1.0).alias("label")).unionByName(synthetic.select(key, *features, F.lit(0.0).alias("label")))
    z, kept = scored(both, features)
    counts = {r.label: r["count"] for r in both.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1, F.lit(sum(counts.values()) / (2 * counts[1.0]))).otherwise(sum(counts.values()) / (2 * counts[0.0]))
    data = assembled(z, kept).select(key, "label", "features", weight.alias("w"), fold_of(key, folds).alias("fold"))
    parts = []
    for i in range(folds):
        model = LogisticRegression(weightCol="w", regParam=1e-3).fit(data.where(F.col("fold") != i))
        parts.append(model.transform(data.where(F.col("fold") == i)).select(key, "label", "w", vector_to_array("rawPrediction")[1].alias("s")))
    scores = reduce(DataFrame.unionByName, parts)
    platt = LogisticRegression(weightCol="w").fit(assembled(scores, ["s"]))
    odds = F.exp(platt.intercept + float(platt.coefficients[0]) * F.col("s"))
    return scores.where("label = 0").select(key, odds.alias("r"))


def emulator_r2(rows: DataFrame, features: list[str], target: str, key: str, folds: int = 5, seed: int = 7) -> DataFrame:
    """(fold, n, r2): out-of-fold fit of boosted trees."""
    from pyspark.ml.regression import GBTRegressor

    data, parts = assembled(rows, features).withColumn("fold", fold_of(key, folds).cast("int")), []
    for i in range(folds):
        model = GBTRegressor(labelCol=target, maxIter=20, maxDepth=3, seed=seed).fit(data.where(F.col("fold") != i))
        parts.append(model.transform(data.where(F.col("fold") == i)).select("fold", target, "prediction"))
    error = F.sum(F.pow(F.col(target) - F.col("prediction"), 2)) / F.nullif(F.count("*") * F.var_pop(target), F.lit(0.0))
    return reduce(DataFrame.unionByName, parts).groupBy("fold").agg(F.count("*").alias("n"), (1 - error).alias("r2"))


def total_effects(runs: DataFrame, base: str, swapped: list[str]) -> DataFrame:
    """(knob, total_effect): Jansen's estimate from runs with one knob redrawn each."""
    spread = F.nullif(2 * F.var_pop(base), F.lit(0.0))
    wide = runs.agg(*((F.avg(F.pow(F.col(base) - F.col(k), 2)) / spread).alias(k) for k in swapped))
    return wide.unpivot([], swapped, "knob", "total_effect")
