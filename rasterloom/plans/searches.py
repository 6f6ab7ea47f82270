"""Queries on the two-stage template search and its saved results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..sources.tables import SERIES, scratch, table

QUERIES: dict = {}
ORACLES: dict = {}
SETTINGS = {"size": 64, "length": 32, "sparse": 10, "dense": 3, "shortlist": 12, "keep": 5}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    templates = vectors.where("vec_id < 8").select(F.col("vec_id").alias("template_id"), F.slice("v", 17, 32).alias("t"))
    return vectors.where("vec_id >= 8"), templates


def _stage(name: str, offsets: list[int], among: str) -> str:
    return f"""{name}p AS (SELECT template_id, w.vec_id, off, sum(w.v) sg, sum(w.v * w.v) sgg, sum(w.v * t.v) sgt, sum(t.v) st, sum(t.v * t.v) stt FROM t, (SELECT unnest({offsets}) AS off) o, {among} w WHERE w.i = t.i + off GROUP BY ALL),
{name}m AS (SELECT *, greatest((sgg - 2 * sgt + stt) / 32 - power((sg - st) / 32, 2), 0) AS mse FROM {name}p), {name} AS (SELECT * FROM {name}m QUALIFY row_number() OVER (PARTITION BY template_id, vec_id ORDER BY mse, off) = 1)"""


_SPARSE, _DENSE = search.axis_offsets(32, SETTINGS["sparse"]), search.axis_offsets(32, SETTINGS["dense"])
TWO_STAGE = f"""WITH {SERIES}, t AS (SELECT vec_id template_id, i - 16 AS i, v FROM e WHERE vec_id < 8 AND i BETWEEN 16 AND 47), w0 AS (SELECT * FROM e WHERE vec_id >= 8), {_stage("a", _SPARSE, "w0")},
l AS (SELECT template_id, vec_id FROM a QUALIFY row_number() OVER (PARTITION BY template_id ORDER BY mse, vec_id) <= {SETTINGS["shortlist"]}), w1 AS (SELECT * FROM w0 WHERE vec_id IN (SELECT vec_id FROM l)), {_stage("b", _DENSE, "w1")},
k AS (SELECT template_id, vec_id, off, round(sqrt(mse), 6) rmse FROM b SEMI JOIN l USING (template_id, vec_id)), q AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY rmse, vec_id) AS rank FROM k)
SELECT template_id, rank::INT AS rank, vec_id, off::INT AS off, rmse FROM q WHERE rank <= {SETTINGS["keep"]}"""


@query(TWO_STAGE)
def two_stage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.two_stage(*_inputs(spark, sf_dir), **SETTINGS).select("template_id", F.inline("best")).select("template_id", "rank", "vec_id", "off", "rmse")


@query(TWO_STAGE)
def saved_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the saved file, which its own fingerprint opens."""
    worlds, templates = _inputs(spark, sf_dir)
    mark, path = search.fingerprint(templates, SETTINGS), f"{scratch(spark)}/search-{uuid.uuid4().hex}"
    search.save_results(search.two_stage(worlds, templates, **SETTINGS), path, mark)
    return search.load_results(spark, path, mark).select("template_id", F.inline("best")).select("template_id", "rank", "vec_id", "off", "rmse")
