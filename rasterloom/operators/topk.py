"""Sliding-window template search with deterministic ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Templates that are sent to every world.
TEMPLATES = 4096


def template_matches(worlds: DataFrame, templates: DataFrame, offsets: list[int], length: int) -> DataFrame:
    """(template_id, vec_id, off, mse): the best offset of each pair by mean-removed squared error.

    worlds (vec_id, v: array<double>), templates (template_id, t: array<double>). The sums run
    inside the arrays, so a pair is one row and never a row for each element. Over TEMPLATES templates raise.
    """
    if templates.limit(TEMPLATES + 1).count() > TEMPLATES:
        raise ValueError("too many templates to send to every world")

    def add(a, f):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))

    t = templates.select("template_id", "t", add(F.col("t"), lambda x: x).alias("st"), add(F.col("t"), lambda x: x * x).alias("stt"))
    w = worlds.select("vec_id", F.explode(F.array(*map(F.lit, offsets))).alias("off"), "v").select("vec_id", "off", F.slice("v", F.col("off") + 1, length).alias("g"))
    w = w.select("vec_id", "off", "g", add(F.col("g"), lambda x: x).alias("sg"), add(F.col("g"), lambda x: x * x).alias("sgg"))
    # Every world meets every template, of which there are TEMPLATES at most.
    both = w.crossJoin(F.broadcast(t))
    sgt = add(F.zip_with("g", "t", lambda a, b: a * b), lambda x: x)
    mse = F.greatest((F.col("sgg") - 2 * sgt + F.col("stt")) / length - F.pow((F.col("sg") - F.col("st")) / length, 2), F.lit(0.0))
    return both.select("template_id", "vec_id", "off", mse.alias("mse")).groupBy("template_id", "vec_id").agg(F.min_by("off", F.struct("mse", "off")).alias("off"), F.min("mse").alias("mse"))


def top_per_group(rows: DataFrame, group: str, order: list, keep: int) -> DataFrame:
    """The first `keep` rows of each group with their rank; Catalyst cuts before and after the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= keep)


def spread_picks(rows: DataFrame, group: str, order: list, picks: int) -> DataFrame:
    """Rows at evenly spread places of each sorted group, ends included (rint of the places)."""
    w = Window.partitionBy(group)
    numbered = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda k: F.rint(k * (F.col("__n") - 1) / F.lit(float(picks - 1))).cast("int"))
    return numbered.where(F.array_contains(wanted, F.col("__i"))).drop("__i", "__n")
