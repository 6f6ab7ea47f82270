"""Written tables in the folder that all executors share.

A table written here replaces lineage: a lost executor costs the tasks it ran, not the
stages before the table. Each write goes to a folder of its own, so concurrent queries and
repeated runs never meet, and ``Workspace.drop`` removes what a later table has replaced.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; local sessions without one get a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    context.setCheckpointDir(made)
    return made


#: Rows and bytes of the Arrow batches that Python gets, against 10000 rows and 64 MB by default.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on makes smaller Arrow batches, unless it has sizes of its own: whole texts are large rows."""
    conf, most = df.sparkSession.conf, "spark.sql.execution.arrow.max"
    for key, default, own in ((f"{most}RecordsPerBatch", "10000", BATCH_ROWS), (f"{most}BytesPerBatch", "67108864b", BATCH_BYTES)):
        if conf.get(key, default) in (default, default.rstrip("b"), "64MB"):
            conf.set(key, str(own))
    return df


class Workspace:
    """Intermediate tables of one query run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/rasterloom-{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write a table and read it again, with the same schema even when it is empty."""
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._rasterloom_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Remove written tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._rasterloom_path)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
