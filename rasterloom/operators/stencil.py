"""Stencils on cells (tile, x, y, z): gradients, second differences, windows, neighbours.

Row and column neighbours are window lags, so each axis costs one shuffle by its line of cells;
diagonal neighbours are equi-joins on shifted coordinates. Missing cells are the mask.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbours in scan order, which settles ties: four orthogonal, four diagonal. Fixed values.
NEIGHBOURS = ((0, -1), (-1, 0), (1, 0), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1))


def _beside(value: str, axis: str, step: int) -> Column:
    """The value `step` cells on along an axis, null where that cell is missing."""
    other = "y" if axis == "x" else "x"
    w = Window.partitionBy("tile", other).orderBy(axis)
    shift = F.lag if step < 0 else F.lead
    return F.when(shift(axis, abs(step)).over(w) == F.col(axis) + step, shift(value, abs(step)).over(w))


def gradient(cells: DataFrame, cell: float = 1.0) -> DataFrame:
    """cells with gx, gy: central differences, one-sided at edges (the actual span), 0 for lone cells."""
    out = cells
    for axis in ("x", "y"):
        out = out.withColumn("__a", _beside("z", axis, -1)).withColumn("__b", _beside("z", axis, 1))
        span = F.col("__a").isNotNull().cast("int") + F.col("__b").isNotNull().cast("int")
        rise = F.coalesce("__b", "z") - F.coalesce("__a", "z")
        out = out.withColumn(f"g{axis}", F.when(span > 0, rise / (span * F.lit(cell))).otherwise(0.0)).drop("__a", "__b")
    return out


def slope(cells: DataFrame, cell: float = 1.0) -> DataFrame:
    """cells with gx, gy and slope = |gradient|."""
    return gradient(cells, cell).withColumn("slope", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def second_differences(cells: DataFrame, cell: float = 1.0) -> DataFrame:
    """Inner cells with fx, fy, fxx, fyy, fxy from their 3 x 3 neighbourhood, all present."""
    out = cells
    for axis in ("x", "y"):
        out = out.withColumn(f"__a{axis}", _beside("z", axis, -1)).withColumn(f"__b{axis}", _beside("z", axis, 1))
    out = out.withColumn("__d", _beside("__by", "x", 1) - _beside("__by", "x", -1) - _beside("__ay", "x", 1) + _beside("__ay", "x", -1))
    found = out.select("tile", "x", "y", "z", *(((F.col(f"__b{a}") - F.col(f"__a{a}")) / (2 * cell)).alias(f"f{a}") for a in "xy"), *(((F.col(f"__b{a}") - 2 * F.col("z") + F.col(f"__a{a}")) / (cell * cell)).alias(f"f{a}{a}") for a in "xy"), (F.col("__d") / (4 * cell * cell)).alias("fxy"))
    return found.where("fx is not null and fy is not null and fxy is not null")


def windowed(cells: DataFrame, radius: int, how, name: str = "w") -> DataFrame:
    """A separable window along x and then y by coordinate range, cut at edges; how: F.avg, F.max or F.min."""
    row = Window.partitionBy("tile", "y").orderBy("x").rangeBetween(-radius, radius)
    column = Window.partitionBy("tile", "x").orderBy("y").rangeBetween(-radius, radius)
    return cells.withColumn("__row", how("z").over(row)).withColumn(name, how("__row").over(column)).drop("__row")


def neighbours(cells: DataFrame) -> DataFrame:
    """Rows (tile, x, y, z, k, nz): the k-th neighbour in scan order, where it is present."""
    offsets = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(NEIGHBOURS)))
    asked = cells.withColumn("o", F.explode(offsets)).select("tile", "x", "y", "z", "o.k", (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"))
    there = cells.select("tile", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"))
    return asked.join(there, ["tile", "nx", "ny"])


def receivers(cells: DataFrame) -> DataFrame:
    """(tile, x, y, k): the neighbour of steepest descent (first in scan order on ties), -1 for none."""
    far = reduce(lambda a, b: a | b, (F.col("k") == k for k, (dx, dy) in enumerate(NEIGHBOURS) if dx and dy))
    drop = (F.col("z") - F.col("nz")) / F.when(far, F.sqrt(F.lit(2.0))).otherwise(1.0)
    best = neighbours(cells).withColumn("drop", drop).where("drop > 0").groupBy("tile", "x", "y").agg(F.max_by("k", F.struct("drop", -F.col("k"))).alias("k"))
    return cells.join(best, ["tile", "x", "y"], "left").select("tile", "x", "y", F.coalesce("k", F.lit(-1)).alias("k"))


def pairs_at(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(tile, lag, a, b): values at each offset apart, both present; lag is the offset's place in the list."""
    each = F.array(*(F.struct(F.lit(i).alias("lag"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(offsets)))
    asked = cells.withColumn("o", F.explode(each)).select("tile", "o.lag", F.col("z").alias("a"), (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"))
    there = cells.select("tile", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("b"))
    return asked.join(there, ["tile", "nx", "ny"]).select("tile", "lag", "a", "b")


def blocks(cells: DataFrame) -> DataFrame:
    """cells with their tile's extent (x0, y0, x1, y1) and the corners of the 2 x 2 block from each cell: a, b beside, c below, d both.

    Blocks at the last column or row repeat it; a corner that is missing within the extent is null.
    """
    extent = cells.groupBy("tile").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    out = cells.join(extent, "tile").withColumn("a", F.col("z")).withColumn("__right", _beside("z", "x", 1))
    out = out.withColumn("b", F.when(F.col("x") == F.col("x1"), F.col("a")).otherwise(F.col("__right")))
    last = F.col("y") == F.col("y1")
    out = out.withColumn("__below", _beside("a", "y", 1)).withColumn("__across", _beside("b", "y", 1))
    out = out.withColumn("c", F.when(last, F.col("a")).otherwise(F.col("__below"))).withColumn("d", F.when(last, F.col("b")).otherwise(F.col("__across")))
    return out.drop("__right", "__below", "__across")


def bilinear(cells: DataFrame, points: DataFrame, how: str = "linear") -> DataFrame:
    """points(tile, px, py) with v: the four cells around blended, x first; null where one is missing.

    Places outside the tile's extent count as the nearest on its edge. how="nearest" takes the cell
    whose centre is nearest, halves upwards.
    """
    grid = blocks(cells)
    extent = grid.groupBy("tile").agg(*(F.first(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")))
    hold = lambda c, low, high: F.least(F.greatest(F.col(c), F.col(low)), F.col(high))
    at = points.join(extent, "tile").withColumn("__px", hold("px", "__x0", "__x1")).withColumn("__py", hold("py", "__y0", "__y1"))
    if how == "nearest":
        cell = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    else:
        cell = lambda c: F.floor(c).cast("int")
    at = at.withColumn("__x", cell("__px")).withColumn("__y", cell("__py"))
    there = grid.select("tile", F.col("x").alias("__x"), F.col("y").alias("__y"), *(F.col(c).alias(f"__{c}") for c in "abcd"))
    at = at.join(there, ["tile", "__x", "__y"], "left")
    if how == "nearest":
        return at.select(*points.columns, F.col("__a").alias("v"))
    u, v = F.col("__px") - F.col("__x"), F.col("__py") - F.col("__y")
    low = F.col("__a") + u * (F.col("__b") - F.col("__a"))
    high = F.col("__c") + u * (F.col("__d") - F.col("__c"))
    return at.withColumn("v", low + v * (high - low)).select(*points.columns, "v")
