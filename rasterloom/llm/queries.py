"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import host_reputation, language_id, license_rules, maxent_lm, mixing, ngram_join, packing, quality, token_files, transport_stream
from .shared import Workspace, table

# Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns have a defined result in
# every operator, stated in its module and covered by tests.


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their shingle set size, component, class size and number of links; ngram_join states the cases."""
    return ngram_join.jaccard_components(spark, table(spark, sf_dir, "documents")).drop("component", "text_key")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the verdict of rules and model; quality states the cases."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(spark, docs, table(spark, sf_dir, "labels")))


def op3_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its bucket, shard, batch and slot; packing states the cases."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a transport stream in a written table, and digests of what is read back from it; transport_stream states the cases."""
    stored = Workspace(spark, "transport-streams").save(transport_stream.store(table(spark, sf_dir, "documents")), "media")
    return transport_stream.digests(stored)


def op5_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the written token frames; token_files states the cases."""
    import public_tokenizers

    frames, shards = token_files.write_frames(spark, Workspace(spark, "token-files"), table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_frames(spark, frames, shards)


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; mixing states the cases."""
    mixed = mixing.copies(spark, table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op7_license_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document by ordered sentence rules; license_rules states the cases."""
    return license_rules.scan(table(spark, sf_dir, "documents"))


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every document, learned from those that are not held out; maxent_lm states the cases."""
    docs, space = table(spark, sf_dir, "documents"), Workspace(spark, "maxent-lm")
    held = maxent_lm.held_out(F.col("doc_id"))
    found = maxent_lm.score(spark, space, docs, *maxent_lm.train(spark, space, docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page; host_reputation states the cases."""
    return host_reputation.filter_urls(table(spark, sf_dir, "pages"))


def op10_zstd_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by compression, learned from those that are not held out; language_id states the cases."""
    docs = table(spark, sf_dir, "documents")
    learned = language_id.train(docs, language_id.in_training())
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return language_id.predict(docs, learned).select("doc_id", held.alias("held_out"), "lang_pred", "score", "reliable")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_rules, op3_length_bucket_packing, op4_transport_streams, op5_rans_token_files, op6_entropy_mixing, op7_license_sentence_rules, op8_maxent_lm, op9_host_reputation, op10_zstd_language_id)}
ORACLES = {"op1_ngram_jaccard_join": ngram_join.oracle(), "op3_length_bucket_packing": packing.oracle(), "op7_license_sentence_rules": license_rules.oracle(), "op9_host_reputation": host_reputation.oracle()}
