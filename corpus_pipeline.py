"""The corpus pipeline: quality rules, near-dedup, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of the pipeline writes
it as Parquet and gives it to the next stage as docs. All but the last return the columns of
documents.

Defined results, in every stage: an empty table gives an empty table of the same columns; columns
beside those of documents are carried along and not read, whatever their names; rows that repeat
are handled one by one; n_chars follows the text where a stage changes it. A null or empty text has
no words, so the quality stage rejects it; given to the others it stays null or empty, is nobody's
near duplicate, has no personal data, size 0 in the mix and a piece of the separator alone. A null
doc_id is a key like any other, and last where the smallest is chosen; a null source is a source of
its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import mixing, near_dedup, packing, pii, quality_rules
from lociframe.llm.common import table, written
from lociframe.llm.registry import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor are depleted of lines of their own, without their boilerplate lines."""
    good = quality_rules.keep_good(docs)
    return good.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of smallest id: shingles of five words, similarity of 0.8 or more."""
    return near_dedup.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_file()).withColumnsRenamed({"key": "doc_id", "crc": "ids_crc32"})


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packed", packed),
]

#: Sampling, signatures and tokenizing have no SQL; the tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
