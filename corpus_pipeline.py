"""The corpus pipeline: stages that each take and return documents, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import lang_id, packing, secrets, simhash, suffix_dedup
from tessera.llm.common import materialize, table


def sized(docs: DataFrame, given: DataFrame) -> DataFrame:
    """n_chars follows a changed text; null texts keep what they had."""
    if "n_chars" not in given.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast(given.schema["n_chars"].dataType), F.col("n_chars")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, unchanged; texts that are null or have no letter go."""
    return lang_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (four-word shingles, four bits): the one with the smallest id."""
    return simhash.keep_one(docs)


#: Bytes of the repeated strings that the pipeline removes: a passage of 50 words has some 300.
REPEAT_BYTES = 200


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the strings of ``REPEAT_BYTES`` bytes that occur more than once."""
    return sized(suffix_dedup.remove_repeats(docs, length=REPEAT_BYTES), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secret spans replaced by a mark."""
    return sized(secrets.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: The stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each reading what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
