"""Corpus pipeline: quality, near-duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of documents. Columns beyond those are left out, whatever they are called. Every stage takes an empty table and gives an empty one, reads
texts of any length whole, and allows nulls in every column; what becomes of nulls, empty texts, ties and repeated rows is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import common, mixing, near_dup, packing, quality_model, span_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among docs, held-out ones excepted.

    A null or empty text is scored like any other, so it stays or goes by its score; rows that repeat doc_id and text share one fate; a
    null doc_id has no label and is scored. Where fewer than two classes are left to learn from, the one there is decides for all.
    """
    labels = common.table(spark, sf_dir, "labels")
    return quality_model.classify(docs.select(COLUMNS), labels).filter("predicted = 1").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of least doc_id, a null doc_id last, ties by the text's digest.

    Rows that repeat doc_id and text are one; a null text is a copy of an empty one; texts without a word are copies of equal texts only.
    """
    return near_dup.deduplicate(docs.select(COLUMNS))


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that repeat earlier ones; those from which all letters and digits went go, others stay.

    Earlier means of lesser doc_id (null last, ties by a hash of the text) or before in the same text. A null or empty text stays as it
    is; rows that repeat doc_id and text are changed alike. n_chars is counted anew.
    """
    kept = span_dedup.remove_repeats(docs.select(COLUMNS))
    kept = kept.filter((F.col("removed_sentences") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    A null or wordless text has no size and isn't taken; a null source is a source of its own, last in order; rows of one doc_id are taken alike.
    """
    return mixing.apply_mix(docs.select(COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null text has just the end id; repeated rows are packed once each."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_spans", repeated_spans), ("source_mix", source_mix), ("pack", pack)]

#: Models, sketches and tokens can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
