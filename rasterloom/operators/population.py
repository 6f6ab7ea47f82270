"""Comparing and reweighting populations: scores, coverage, density ratios, KS, energy, Sobol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def standardise(rows: DataFrame, group: str, value: str) -> DataFrame:
    """rows with zscore by group, population deviation; null where the group has none."""
    stats = rows.groupBy(group).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return rows.join(stats, group).withColumn("zscore", F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def reachability(synthetic: DataFrame, real: DataFrame, group: str, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(group, lo, hi, share): the share of real values within the synthetic percentiles."""
    span = synthetic.groupBy(group).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("__p")).select(group, F.col("__p")[0].alias("lo"), F.col("__p")[1].alias("hi"))
    return real.join(span, group).groupBy(group, "lo", "hi").agg(F.avg(F.col(value).between(F.col("lo"), F.col("hi")).cast("double")).alias("share"))


def quantiles(rows: DataFrame, value: str, shares: list[float], slices: int = 256) -> list[float | None]:
    """Exact quantiles of a whole column, interpolated linearly between order statistics; nulls when there are none.

    Counts by distinct value are cut into slices at approximate quantiles. The counts of the slices tell
    in which the wanted places lie, and only these are sorted, so nothing wider than a slice meets in one task.
    """
    counts = written(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")))
    cuts = counts.agg(F.percentile_approx("v", [i / slices for i in range(1, slices)], 10000)).first()[0]
    if not cuts:
        return [None] * len(shares)
    cuts = sorted(set(cuts))
    slice_of = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("v")))
    placed = counts.withColumn("slice", slice_of)
    base, total = {}, 0
    for r in sorted(placed.groupBy("slice").agg(F.sum("c").alias("n")).collect()):
        base[r["slice"]] = total, total + r["n"]
        total += r["n"]
    places = sorted({k for q in shares for k in (int(q * (total - 1)), min(total - 1, int(q * (total - 1)) + 1))})
    wanted = {k: next(s for s, (a, b) in base.items() if a <= k < b) for k in places}
    run = placed.where(F.col("slice").isin(*set(wanted.values()))).withColumn("to", F.sum("c").over(Window.partitionBy("slice").orderBy("v")))
    start = F.element_at(F.create_map(*(F.lit(x) for s in set(wanted.values()) for x in (s, base[s][0]))), F.col("slice"))
    held = F.filter(F.array(*map(F.lit, places)), lambda k: (k < start + F.col("to")) & (k >= start + F.col("to") - F.col("c")))
    at = {k: r["v"] for r in run.select("v", F.explode(held).alias("k")).collect() for k in [r["k"]]}
    out = []
    for q in shares:
        low = int(q * (total - 1))
        a, b = at[low], at[min(total - 1, low + 1)]
        out.append(a + (q * (total - 1) - low) * (b - a))
    return out


def best_names(a: DataFrame, key: str, tokens: str, b: DataFrame, other: str, others: str, least: float) -> DataFrame:
    """(key, other, score): for each row of a the row of b whose tokens are most alike (Jaccard), first by `other` on ties, from `least` on.

    Rows meet on a shared token, so overlaps are counts of an equi-join; without one the score is 0.
    """
    x = a.where(F.size(tokens) > 0).select(key, F.size(tokens).alias("na"), F.explode(tokens).alias("token"))
    y = b.where(F.size(others) > 0).select(other, F.size(others).alias("nb"), F.explode(others).alias("token"))
    both = x.join(y, "token").groupBy(key, other).agg(F.count("*").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    scored = both.select(key, other, F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy(key).agg(F.min(F.struct(-F.col("score"), F.col(other))).alias("best"))
    return best.select(key, F.col(f"best.{other}").alias(other), (-F.col("best.col1")).alias("score"))


def tempered_weights(ratios: DataFrame, temper: float = 0.5, cap: float = 0.98) -> DataFrame:
    """ratios(key, r) with w: r^temper, capped at a percentile, normalised to 1."""
    powered = ratios.withColumn("__w", F.pow("r", F.lit(temper)))
    (limit,) = quantiles(powered, "__w", [cap])
    capped = powered.withColumn("__w", F.least("__w", F.lit(limit)))
    total = capped.agg(F.sum("__w").alias("__total"))
    return capped.join(F.broadcast(total)).withColumn("w", F.col("__w") / F.col("__total")).drop("__w", "__total")


def running_shares(a: DataFrame, b: DataFrame, group: str | None, value: str, each: int = 50_000) -> DataFrame:
    """(group, v, fa, fb, next): both empirical distributions at each distinct value, and the next value.

    Counts by distinct value pre-aggregate. A group's values are then cut into slices at approximate
    quantiles: running sums go within a slice, and slices get the sums of those before them, so
    no group runs through one task. Any cut gives the same result. Null values count for nothing.
    """
    key = [group] if group else []
    both = a.select(*key, F.col(value).alias("v"), F.lit(1).alias("in_a")).unionByName(b.select(*key, F.col(value).alias("v"), F.lit(0).alias("in_a")))
    # Written, as the cuts, the sums and the shares all start from it.
    by_value = written(both.where("v is not null").groupBy(*key, "v").agg(F.sum("in_a").alias("na"), F.sum(1 - F.col("in_a")).alias("nb")))
    # About so many values a slice and group.
    slices = min(1024, max(8, by_value.count() // each))
    cuts = by_value.groupBy(*key).agg(F.percentile_approx("v", [i / slices for i in range(1, slices)], 10000).alias("__cuts"))
    placed = (by_value.join(cuts, group) if group else by_value.crossJoin(cuts)).withColumn("__slice", F.size(F.filter("__cuts", lambda c: c <= F.col("v")))).drop("__cuts")
    sums = placed.groupBy(*key, "__slice").agg(F.sum("na").alias("sa"), F.sum("nb").alias("sb"), F.min("v").alias("__first"))
    over, whole = Window.partitionBy(*key).orderBy("__slice"), Window.partitionBy(*key)
    before = sums.select(*key, "__slice", *((F.sum(c).over(over) - F.col(c)).alias(f"__{c}") for c in ("sa", "sb")), *(F.sum(c).over(whole).alias(f"__all_{c}") for c in ("sa", "sb")), F.lead("__first").over(over).alias("__then"))
    w = Window.partitionBy(*key, "__slice").orderBy("v")
    share = lambda n, s: (F.sum(n).over(w) + F.col(f"__{s}")) / F.nullif(F.col(f"__all_{s}"), F.lit(0))
    return placed.join(before, [*key, "__slice"]).select(*key, "v", share("na", "sa").alias("fa"), share("nb", "sb").alias("fb"), F.coalesce(F.lead("v").over(w), "__then").alias("next"))


def ks_two_sample(a: DataFrame, b: DataFrame, group: str, value: str) -> DataFrame:
    """(group, ks): the largest gap of the two empirical distributions."""
    return running_shares(a, b, group, value).groupBy(group).agg(F.max(F.abs(F.col("fa") - F.col("fb"))).alias("ks"))


def energy_distance(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row (energy): 2E|A-B| - E|A-A'| - E|B-B'|, from sorted sums and not from pairs.

    Twice the integral of the squared gap of the two distributions.
    """
    gap = F.col("fa") - F.col("fb")
    return running_shares(a, b, None, value).agg((2 * F.sum(gap * gap * (F.col("next") - F.col("v")))).alias("energy"))


def quantile_bin_ratio(target: DataFrame, fitted: DataFrame, value: str, bins: int, strength: float, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """fitted with w: each row's share of its target-quantile bin, ratio^strength, clipped, normalised."""
    edges = [i / bins for i in range(1, bins)]
    cut = F.array(*map(F.lit, quantiles(target, value, edges)))
    binned = fitted.withColumn("bin", F.size(F.filter(cut, lambda q: q <= F.col(value))))
    counts = binned.groupBy("bin").agg(F.count("*").alias("__n"))
    whole = counts.agg(F.sum("__n").alias("__all"))
    ratio = counts.join(F.broadcast(whole)).withColumn("__r", F.least(F.lit(high), F.greatest(F.lit(low), F.pow(F.lit(1.0 / bins) / (F.col("__n") / F.col("__all")), F.lit(strength)))))
    total = ratio.agg(F.sum(F.col("__n") * F.col("__r")).alias("__total"))
    return binned.join(F.broadcast(ratio.join(F.broadcast(total)).select("bin", "__r", "__total")), "bin").withColumn("w", F.col("__r") / F.col("__total")).drop("__r", "__total")
