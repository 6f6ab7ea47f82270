"""JSON records: manifests of runs, settings, survey records; and ranges of seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seeds(spark: SparkSession, start: int, count: int, chunk: int = 512) -> DataFrame:
    """(seed, chunk): a range of seeds in partitions of so many, made where they are used."""
    rows = spark.range(start, start + count, 1, max(1, -(-count // chunk)))
    return rows.select(F.col("id").alias("seed"), F.floor((F.col("id") - start) / chunk).alias("chunk"))


def manifest(spark: SparkSession, path: str, schema: str, drawn: dict[str, Column] | None = None) -> DataFrame:
    """Items of JSON lists or lines; parameters that an item leaves out are drawn: columns of the item's others.

    Items that are no records of the schema are refused: the read fails.
    """
    items = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    return items.select(*(F.coalesce(F.col(c), (drawn or {})[c]).alias(c) if c in (drawn or {}) else F.col(c) for c in items.columns))


def records(spark: SparkSession, folder: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Survey records of a folder's *.json files with their file's name as key, those without a required field left out."""
    found = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    kept = found.withColumn("key", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
    for c in required:
        kept = kept.where(F.col(c).isNotNull())
    return kept


def embedded(spark: SparkSession, path: str, before: str, after: str, schema: str) -> DataFrame:
    """(key, record): the JSON map that stands between two marks in a text file, a row for each entry."""
    whole = spark.read.text(path, wholetext=True)
    part = F.substring_index(F.element_at(F.split("value", before, 2), 2), after, 1)
    parsed = whole.select(F.from_json(F.regexp_replace(part, ";\\s*$", ""), T.MapType(T.StringType(), T.StructType.fromDDL(schema))).alias("m"))
    return parsed.select(F.explode("m").alias("key", "record"))


def settings(path: str) -> dict:
    """A settings file: JSON, or the plain part of YAML (nested keys by indentation, scalars and [lists])."""
    import json

    with open(path) as file:
        text = file.read()
    if text.lstrip().startswith("{"):
        return json.loads(text)

    def scalar(x: str):
        if x.startswith("["):
            return [scalar(y.strip()) for y in x[1:-1].split(",") if y.strip()]
        try:
            return json.loads(x)
        except ValueError:
            return x.strip("\"'")

    out: dict = {}
    levels = [(-1, out)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent = len(body) - len(body.lstrip())
        key, _, value = body.strip().partition(":")
        while levels[-1][0] >= indent:
            levels.pop()
        if value.strip():
            levels[-1][1][key] = scalar(value.strip())
        else:
            levels[-1][1][key] = {}
            levels.append((indent, levels[-1][1][key]))
    return out
