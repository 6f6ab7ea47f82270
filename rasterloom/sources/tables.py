"""Tables of a data folder, and rasters, polylines and series derived from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; local sessions without one get a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or tempfile.mkdtemp(prefix="rasterloom-")).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The table written in the shared folder and read again: what starts from it doesn't compute it anew."""
    path = f"{scratch(df.sparkSession)}/rasterloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows spread over all shuffle partitions by their keys; a stated number, which adaptive plans don't merge."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (tile, x, y, z): mean quantity on a 32 x 32 lattice of parts and orders, by flags."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("tile"), (F.col("l_partkey") % SIDE).cast("int").alias("x"), (F.col("l_orderkey") % SIDE).cast("int").alias("y")).agg(F.avg("l_quantity").alias("z"))


def supplier_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (tile, x, y, z) of 16 x 16 lattices, a tile for every ten suppliers: their number grows with the data."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.floor(F.col("l_suppkey") / 10).cast("string").alias("tile"), (F.col("l_partkey") % 16).cast("int").alias("x"), (F.col("l_orderkey") % 16).cast("int").alias("y")).agg(F.avg("l_quantity").alias("z"))


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices (line, i, px, py): a user's events in time order, at (place, value)."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("line"), at.alias("i"), at.cast("double").alias("px"), F.col("value").alias("py"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements (vec_id, i, v) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


#: The same in DuckDB SQL, as common table expressions.
RASTER = "r AS (SELECT l_returnflag || l_linestatus AS tile, (l_partkey % 32)::INT AS x, (l_orderkey % 32)::INT AS y, avg(l_quantity) AS z FROM lineitem GROUP BY ALL)"
SUPPLIER_TILES = "r AS (SELECT (l_suppkey // 10)::VARCHAR AS tile, (l_partkey % 16)::INT AS x, (l_orderkey % 16)::INT AS y, avg(l_quantity) AS z FROM lineitem GROUP BY ALL)"
LINES = "l AS (SELECT user_id AS line, row_number() OVER w AS i, (row_number() OVER w)::DOUBLE AS px, value AS py FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
SERIES = "e AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"
