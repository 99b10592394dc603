"""The thin queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_documents
from .common import table
from .cotraining import classify_quality
from .decontamination import contamination
from .jaccard_join import jaccard_join
from .licenses import scan_licences
from .merkle import manifest, manifest_sql, verified
from .oracles import JACCARD_SQL, SUBSTRING_SQL, quality_sql
from .packing import pack_documents
from .pii import replace_pii
from .quality_rules import BUCKETS, THRESHOLD, quality_rules
from .sharding import SHARDING_SQL, shard_documents
from .substring_dedup import remove_repeated
from .token_blocks import token_table_digest
from .vector_dedup import VECTOR_SQL, link_vectors

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text in a shard.
SHARD_BYTES = 32 << 20
#: The setting that has the secret of the surrogates; without it, one is drawn for each driver process.
PII_KEY_CONF = "spark.driftgrid.pii.key"
_DRAWN_KEY = secrets.token_hex(16)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def pii_key(spark: SparkSession) -> str:
    """The secret of the surrogates: with the same one, surrogates agree between runs, and whoever has it can make them again."""
    return spark.conf.get(PII_KEY_CONF, None) or _DRAWN_KEY


def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_entities")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.select(*first, *[c for c in rules.columns if c not in first])


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shift", "matched", "item_tokens", "exact")


def op8_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table_digest(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(manifest(table(spark, sf_dir, "documents")))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_co_training, op2_pii_surrogates, op3_best_fit_packing, op4_licence_scan, op5_extendible_sharding, op6_quality_rules,
    op7_template_decontamination, op8_token_blocks, op9_substring_dedup, op10_jaccard_join, op11_token_alignment, op12_merkle_manifest,
    op13_vector_dedup,
)}

ORACLE_SQL: dict[str, str] = {
    "op5_extendible_sharding": SHARDING_SQL.format(limit=SHARD_BYTES),
    "op6_quality_rules": quality_sql(BUCKETS, THRESHOLD),
    "op9_substring_dedup": SUBSTRING_SQL,
    "op10_jaccard_join": JACCARD_SQL,
    "op12_merkle_manifest": manifest_sql(),
    "op13_vector_dedup": VECTOR_SQL,
}
