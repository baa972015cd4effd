"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from ._common import table
from .byte_bpe import round_trip
from .conversation_repair import damage, repair_conversations
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .license_scan import digest_licenses, scan_licenses
from .merkle_manifest import manifest, tampered_text, verified
from .quality_model import fit_quality, score_quality
from .secret_scan import digest_secrets, scan_secrets
from .sequence_packing import pack_documents
from .simhash_dedup import simhash_dedup
from .source_mix import mix_sources
from .suffix_dedup import remove_repeats
from .url_filter import filter_urls, url_sql


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_secrets(scan_secrets(table(spark, sf_dir, "documents")))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_licenses(scan_licenses(table(spark, sf_dir, "documents")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"), width=400, with_text=False)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(manifest(table(spark, sf_dir, "documents"), tampered_text()))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))


ORACLES: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op8_url_filter": url_sql(),
}


def queries() -> dict:
    found = [op1_secret_scan, op2_source_mix, op3_exact_dedup, op4_license_scan, op5_byte_bpe, op6_suffix_dedup, op7_embedding_dedup, op8_url_filter, op9_simhash_dedup, op10_quality_model, op11_merkle_manifest, op12_best_fit_packing, op13_conversation_repair]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
