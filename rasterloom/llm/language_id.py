"""Language identification by compression with per-language zstandard dictionaries.

Each language's dictionary is raw content: lower-cased passages of training documents. A text is
lower-cased, cut into pieces of whole code points, and every piece compressed with every
dictionary; the language of the smallest total wins. The score is the relative margin to the
second (0 to 1; 1 with a single language), and a text whose margin is under ``least_margin`` is
rejected. Ties go to the language that sorts first.

The dictionaries are fitted on a documented bounded sample: about ``sample`` training documents of
each of the ``languages`` most frequent languages, the least by a hash of doc_id and text. Of each
comes one passage, from a place of the whole text that a second hash chooses, of an equal share of
the ``content`` bytes, so all sampled rows are in the dictionary. Predictions read whole texts.

Null texts and texts without a letter are ``und`` with score 0, and so is everything when no
language was learned, as from an empty table, which itself gives no rows. A null doc_id is not
learned from. Rows that repeat count once among the passages and are predicted each. A text of any
length is compressed piece by piece. predict() returns its own columns only; keep_reliable() returns
those of docs, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches

SAMPLE, CONTENT, LANGUAGES, PIECE, LEVEL, LEAST_MARGIN = 400, 110_000, 256, 2048, 6, 0.01
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Raw dictionary content by language."""

    content: dict[str, bytes]
    piece: int = PIECE
    level: int = LEVEL

    def compressors(self) -> list:
        import zstandard

        made = []
        for name in sorted(self.content):
            d = zstandard.ZstdCompressionDict(self.content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            made.append((name, zstandard.ZstdCompressor(dict_data=d, level=self.level, write_content_size=False, write_dict_id=False).compress))
        return made

    def classify(self, text: str | None, compressors: list) -> tuple[str, float]:
        if text is None or not compressors or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        raw = text.lower()
        pieces = [raw[i : i + self.piece].encode("utf-8", "replace") for i in range(0, len(raw), self.piece)]
        sizes = sorted((sum(len(compress(p)) for p in pieces), name) for name, compress in compressors)
        return sizes[0][1], (1 - sizes[0][0] / sizes[1][0]) if len(sizes) > 1 else 1.0


def train(docs: DataFrame, keep: Column, sample: int = SAMPLE, content: int = CONTENT, languages: int = LANGUAGES) -> LanguageModel:
    """Learn from rows of docs(doc_id, text, lang) where `keep` holds and lang is not null."""
    rows = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = {r.lang: r.n for r in most.collect()}
    if not counts:
        return LanguageModel({})
    # A share of each language by hash, so that about `sample` rows of it come.
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(1 << 40, (sample << 40) // n))) for lang, n in sorted(counts.items())))
    each = content // sample
    place = F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.length("text") - each + 1, F.lit(1))).cast("int") + 1
    some = rows.where(at < share).select("lang", at.alias("at"), F.lower(F.substr("text", place, F.lit(each))).alias("passage")).distinct()
    got = some.orderBy("at", "lang", "passage").limit(2 * sample * len(counts)).collect()
    held: dict[str, list] = {}
    for r in got:
        # A passage cut within a code point loses that one.
        held.setdefault(r.lang, []).append(r.passage.encode("utf-8", "replace")[: each - 1].decode("utf-8", "ignore"))
    return LanguageModel({lang: "\n".join(texts).encode()[-2 * content :] for lang, texts in held.items() if "".join(texts).strip()})


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and reliable of each row of docs(doc_id, text)."""
    # Fields, not the object: executors need not have this package.
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(**sent.value)
        compressors = model.compressors()
        for batch in batches:
            found = [model.classify(x.as_py(), compressors) for x in batch.column(1)]
            lang, score = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([x != UNKNOWN and s >= LEAST_MARGIN for x, s in found], pa.bool_())], ["doc_id", "lang_pred", "score", "reliable"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, reliable boolean")


def keep_reliable(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows whose language is told with enough margin, with all their columns."""
    # Fields, not the object: executors need not have this package.
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(**sent.value)
        compressors = model.compressors()
        for batch in batches:
            found = [model.classify(x.as_py(), compressors) for x in batch.column(text)]
            yield batch.filter(pa.array([lang != UNKNOWN and s >= LEAST_MARGIN for lang, s in found], pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def in_training(spark: SparkSession | None = None) -> Column:
    """Documents to learn from: crc32 of doc_id as text, modulo 4, is not 2."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 != 2
