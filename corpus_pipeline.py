"""A corpus pipeline of five stages: quality, language, near duplicates, mixture, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), where docs has the
columns of documents, and returns what it keeps with the same columns, but for the last, which
returns packed batches. run() writes each stage as Parquet in the shared folder and reads it
again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import language_id, mixing, ngram_join, packing, quality
from rasterloom.llm.shared import Workspace, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the model trained on the labels."""
    return quality.keep_good(docs, quality.train(spark, docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells with enough margin."""
    return language_id.keep_reliable(docs, language_id.train(docs, language_id.in_training()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one of the least doc_id, of these the one of the least hash of its text.

    A document is a doc_id with a text: other texts under the same doc_id have components of their
    own, and rows that repeat a document go but one (the least by a hash of the row). Documents
    without words are linked with nothing and stay. A row without doc_id can't stand for a component
    nor be told from others, so it stays.
    """
    found = ngram_join.jaccard_components(spark, docs).where("doc_id is not null")
    least = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("least")).select("least.*")
    kept = least.union(found.where("component is null").select("doc_id", "text_key")).distinct().select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key")).agg(F.min_by(row, F.xxhash64(row)).alias("row"))
    return once.join(kept, ["id", "key"], "left_semi").select("row.*").unionAll(docs.where("doc_id is null"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, so that each source comes to its share of the tokens."""
    return mixing.repeat_copies(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents of like length within the token budget."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language identification", language),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixture),
    ("packing", packed),
]
#: The quality model, the dictionaries and the bucket search are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    space, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, space.save(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            space.drop(before)
    return docs
