"""The corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor left. All but the last return the
columns of ``documents``; where a stage changes a text, n_chars follows it. All stages: columns beyond those are dropped,
whatever their names; repeated rows are judged alike; null values in lang, source and n_chars stay; texts are read whole,
however long; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import pii, quality, simhash, substring_dedup
from plumbline.llm._common import attach, materialize
from plumbline.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _shaped(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are cut; documents that fail, or lose too much by that, go. A null text fails."""
    judged = quality.measure(docs.select(*COLUMNS))
    return _shaped(judged.filter("kept").withColumn("text", F.col("text_cleaned")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id stays; rows that repeat that id stay together.

    A null text has no words, and all texts without words are one group. A row without an id goes if its text has a copy
    with one, and stays otherwise.
    """
    docs = docs.select(*COLUMNS)
    groups = simhash.similar_texts(docs)
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(first.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that an earlier document has are cut; a document may be left without text.

    A null text stays null; a row without an id stays whole; rows of one id are no earlier than each other.
    """
    return _shaped(substring_dedup.dedup_substrings(docs.select(*COLUMNS)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is put as its kind, terms that reveal it are left out or put as a general term. A null text stays null."""
    found = pii.find_personal(docs.select(*COLUMNS), *COLUMNS, anywhere=True)
    return _shaped(found.withColumn("text", pii.sanitise(F.col("text"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all documents. A null text is empty: one id, the end. A null doc_id stays null."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: Word windows across documents and token packing have no SQL twin; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again."""
    attach(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
