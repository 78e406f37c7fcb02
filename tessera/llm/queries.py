"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (bitslice_topk, bpe_automaton, bpe_monoid, html_lines, lang_id, merkle, packing, secrets, simhash, suffix_dedup, syncmers,
                         token_counts, whitening)
from tessera.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op2_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lines.extract_pages(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_monoid.encode_round_trip(table(spark, sf_dir, "documents"))


def op6_bitslice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice_topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edited(table(spark, sf_dir, "documents"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.dataset_manifest(table(spark, sf_dir, "documents"))


def op12_automaton_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_round_trip(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_extract_main_text, op3_suffix_dedup, op4_token_counts, op5_bpe_round_trip, op6_bitslice_topk, op7_pack_documents,
    op8_syncmer_fingerprints, op9_simhash_groups, op10_secret_scan, op11_merkle_manifest, op12_automaton_bpe, op13_whitening)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op11_merkle_manifest": merkle.oracle(),
    "op6_bitslice_topk": """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
    SELECT a.row, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row
), r AS (
    SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
}
