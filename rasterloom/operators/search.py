"""Two-stage template search: a sparse look at every world, a dense one at the shortlisted, and kept results.

Worlds are (vec_id, v), templates (template_id, t): arrays of numbers. Stage one tries few offsets and
shortlists worlds for each template; stage two makes the distinct shortlisted worlds once, tries
offsets densely and ranks. Templates without a hit keep an empty list. Saved results carry a
fingerprint of templates, settings and versions, and are refused when it differs.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .topk import template_matches, top_per_group

#: A change of how worlds are scored is a change of this.
VERSION = 1
RESULT = "template_id bigint, fingerprint string, best array<struct<rank:int,vec_id:bigint,off:int,rmse:double>>"


def axis_offsets(slack: int, step: int) -> list[int]:
    """0, step, ... up to the slack, the end always included."""
    out = list(range(0, slack + 1, max(1, step)))
    return out if out[-1] == slack else [*out, slack]


def two_stage(worlds: DataFrame, templates: DataFrame, size: int, length: int, sparse: int, dense: int, shortlist: int, keep: int, make=None) -> DataFrame:
    """(template_id, best): the first `keep` worlds by (rmse, vec_id) of each template.

    make: a function that makes the worlds of the ids in a column vec_id anew, finer; none: they stay as they are.
    """
    slack = size - length
    first = template_matches(worlds, templates, axis_offsets(slack, sparse), length)
    listed = top_per_group(first, "template_id", ["mse", "vec_id"], shortlist).select("template_id", "vec_id")
    wanted = listed.select("vec_id").distinct()
    finer = make(wanted) if make else worlds.join(wanted, "vec_id")
    second = template_matches(finer, templates, axis_offsets(slack, dense), length).join(listed, ["template_id", "vec_id"])
    ranked = top_per_group(second.withColumn("rmse", F.round(F.sqrt("mse"), 6)), "template_id", ["rmse", "vec_id"], keep)
    best = ranked.groupBy("template_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "off", "rmse"))).alias("best"))
    none = F.array().cast("array<struct<rank:int,vec_id:bigint,off:int,rmse:double>>")
    return templates.select("template_id").join(best, "template_id", "left").select("template_id", F.coalesce("best", none).alias("best"))


def fingerprint(templates: DataFrame, settings: dict) -> str:
    """A digest of the templates, whatever their order, the settings and the version."""
    seen = templates.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("template_id", "t")).alias("x"), F.sum(F.xxhash64("template_id", "t").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(json.dumps([VERSION, seen["n"], seen["x"], str(seen["s"]), sorted(settings.items())]).encode()).hexdigest()[:16]


def save_results(results: DataFrame, path: str, mark: str) -> None:
    """Write results as JSON lines, each with the fingerprint."""
    results.select("template_id", F.lit(mark).alias("fingerprint"), "best").write.mode("overwrite").json(path)


def load_results(spark: SparkSession, path: str, mark: str) -> DataFrame | None:
    """Saved results, or None where their fingerprint is another: they are stale."""
    found = spark.read.schema(RESULT).json(path)
    if found.where(~F.col("fingerprint").eqNullSafe(F.lit(mark))).limit(1).count():
        return None
    return found.drop("fingerprint")
