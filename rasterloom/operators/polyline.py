"""Windows along polylines (line, i, px, py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along():
    """The vertices of a line in order."""
    return Window.partitionBy("line").orderBy("i")


def arc_lengths(points: DataFrame) -> DataFrame:
    """points with seg (from the previous vertex) and s (from the start)."""
    seg = F.coalesce(F.sqrt(F.pow(F.col("px") - F.lag("px").over(along()), 2) + F.pow(F.col("py") - F.lag("py").over(along()), 2)), F.lit(0.0))
    return points.withColumn("seg", seg).withColumn("s", F.sum("seg").over(along()))


def resample(points: DataFrame, spacing: float) -> DataFrame:
    """(line, k, s, px, py) at every spacing along a line, interpolated between its vertices."""
    s = arc_lengths(points)
    ahead = s.select("line", "i", "s", "px", "py", F.lead("s").over(along()).alias("s1"), F.lead("px").over(along()).alias("qx"), F.lead("py").over(along()).alias("qy")).where("s1 > s")
    first, last = F.ceil(F.col("s") / spacing).cast("long"), (F.ceil(F.col("s1") / spacing) - 1).cast("long")
    each = ahead.where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    u = (F.col("k") * spacing - F.col("s")) / (F.col("s1") - F.col("s"))
    return each.select("line", "k", (F.col("k") * F.lit(spacing)).alias("s"), (F.col("px") + u * (F.col("qx") - F.col("px"))).alias("px"), (F.col("py") + u * (F.col("qy") - F.col("py"))).alias("py"))


def smooth_121(points: DataFrame, passes: int = 1) -> DataFrame:
    """The 1-2-1 mean of py, ends pinned."""
    out = points
    for _ in range(passes):
        a, b = F.lag("py").over(along()), F.lead("py").over(along())
        out = out.withColumn("__p", F.when(a.isNull() | b.isNull(), F.col("py")).otherwise((a + 2 * F.col("py") + b) / 4)).withColumn("py", F.col("__p")).drop("__p")
    return out


def longest_run(points: DataFrame, holds: Column) -> DataFrame:
    """(line, longest): the most vertices in a row where the condition holds."""
    marked = points.withColumn("__h", holds.cast("int")).withColumn("__g", F.sum(1 - F.col("__h")).over(along()))
    runs = marked.where("__h = 1").groupBy("line", "__g").agg(F.count("*").alias("n"))
    best = runs.groupBy("line").agg(F.max("n").alias("longest"))
    return points.select("line").distinct().join(best, "line", "left").select("line", F.coalesce("longest", F.lit(0)).alias("longest"))


def ema(points: DataFrame, keep: float = 0.6) -> DataFrame:
    """points with e: keep * py + (1 - keep) * the previous e; folds each line's ordered array."""
    ordered = points.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("i", "py"))).alias("a"))
    start = F.array().cast("array<struct<i:int,py:double,e:double>>")
    fold = F.aggregate("a", start, lambda out, p: F.concat(out, F.array(F.struct(p["i"].alias("i"), p["py"].alias("py"), F.when(F.size(out) == 0, p["py"]).otherwise(keep * p["py"] + (1 - keep) * F.element_at(out, -1)["e"]).alias("e")))))
    return ordered.select("line", F.inline(fold))
