"""Ranks, cumulative weights and draws over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, mark: Column, order: list, slice_of: Column, group: list[str] | None = None) -> DataFrame:
    """rows with rank (from 1) by `order` and n, the rows of the group (or of all).

    slice_of must rise with the order (any coarse prefix of it does): ranks run within a slice, to
    which the counts of the slices before are added. `mark` is what the order's hash is of; it is
    kept as __mark for `order` and `slice_of` to use.
    """
    group = group or []
    placed = rows.withColumn("__mark", mark).withColumn("__slice", slice_of)
    counts = placed.groupBy(*group, "__slice").agg(F.count("*").alias("__c"))
    before = counts.select(*group, "__slice", (F.sum("__c").over(Window.partitionBy(*group).orderBy("__slice")) - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy(*group)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*group, "__slice").orderBy(*order))
    return placed.withColumn("__i", inside).join(before, [*group, "__slice"]).withColumn("rank", F.col("__i") + F.col("__before")).drop("__mark", "__slice", "__i", "__before")


def hash_order(rows: DataFrame, key: Column, group: list[str] | None = None) -> DataFrame:
    """rows with rank and n in the order of the MD5 of a key, a stable shuffle whatever the partitions."""
    return numbered(rows, F.md5(key), ["__mark"], F.substring("__mark", 1, 3), group)


def hash_unit(key: Column) -> Column:
    """A uniform number in [0, 1) by the first 32 bits of a key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)


#: Sobol dimensions after the first: degree, coefficients of the primitive polynomial, first odd numbers. Fixed values.
SOBOL = ((1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)))


def direction_numbers(dim: int, bits: int = 32) -> list[int]:
    """By the polynomial's recurrence; dimension 0 is the bit-reversed count."""
    if dim == 0:
        return [1 << bits - 1 - k for k in range(bits)]
    degree, polynomial, start = SOBOL[dim - 1]
    m = list(start)
    for k in range(degree, bits):
        new = m[k - degree] ^ m[k - degree] << degree
        for j in range(1, degree):
            if polynomial >> degree - 1 - j & 1:
                new ^= m[k - j] << j
        m.append(new)
    return [x << bits - 1 - k for k, x in enumerate(m)]


def sobol(n: Column, dim: int, scramble: int = 0) -> Column:
    """The n-th point's coordinate in [0, 1), digits flipped by a scramble; each row on its own, so points spread over any partitions."""
    out = F.lit(scramble).cast("bigint")
    for k, v in enumerate(direction_numbers(dim)):
        out = out.bitwiseXOR(F.when(F.shiftright(n.cast("bigint"), k).bitwiseAND(F.lit(1)) == 1, F.lit(v).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out / F.lit(4294967296.0)


def cumulative(weights: DataFrame, key: str, weight: str, slices: int = 1024) -> DataFrame:
    """weights with low and high, the share of weight before a row and with it, in the order of an integer key.

    Slices are of `slices` keys, or of more where that would make over 65536 of them.
    """
    least, most = weights.agg(F.min(key), F.max(key)).first()
    width = max(slices, -(-(most - least + 1) // 65536)) if least is not None else slices
    placed = weights.withColumn("__slice", F.floor(F.col(key) / width))
    sums = placed.groupBy("__slice").agg(F.sum(weight).alias("__s"))
    # 65536 rows at most go through this window.
    over = Window.orderBy("__slice")
    before = sums.select("__slice", (F.sum("__s").over(over) - F.col("__s")).alias("__before"), F.sum("__s").over(Window.partitionBy()).alias("__all"))
    run = F.sum(weight).over(Window.partitionBy("__slice").orderBy(key)) + F.col("__before")
    return placed.join(before, "__slice").withColumn("high", run / F.col("__all")).withColumn("low", (run - F.col(weight)) / F.col("__all")).drop("__slice", "__before", "__all")


def draw(draws: DataFrame, unit: str, cdf: DataFrame, key: str, slices: int = 4096) -> DataFrame:
    """draws with the key whose share [low, high) holds the unit number.

    Shares are cut at multiples of 1/slices and draws fall into one of them, so the range join is an equi-join.
    """
    cut = cdf.where("high > low").select(key, "low", "high", F.explode(F.sequence(F.floor(F.col("low") * slices), F.least(F.floor(F.col("high") * slices), F.lit(slices - 1)))).alias("__slice"))
    asked = draws.withColumn("__slice", F.least(F.floor(F.col(unit) * slices), F.lit(slices - 1)))
    return asked.join(cut, "__slice").where((F.col(unit) >= F.col("low")) & (F.col(unit) < F.col("high"))).drop("__slice", "low", "high")
