"""Queries that apply each operator to its whole table with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op01_token_lengths import token_lengths
from .op02_toxicity import toxicity
from .op03_minhash import near_duplicates
from .op04_vector_forest import near_vectors
from .op05_licenses import scan_licenses
from .op06_bpe import encode_digests
from .op07_lines import dedup_lines
from .op08_wrappers import extract
from .op09_media import described, to_media
from .op10_packing import pack
from .op11_conversations import repaired
from .op12_manifest import verified
from .op13_compression import quality_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths(table(spark, sf_dir, "documents"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


def op7_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(to_media(table(spark, sf_dir, "documents")))


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))


def op13_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_lengths,
        op2_toxicity_chain,
        op3_minhash_stars,
        op4_vector_forest,
        op5_license_templates,
        op6_bpe_tree,
        op7_line_minhash,
        op8_html_wrappers,
        op9_avi_media,
        op10_pattern_packing,
        op11_conversation_repair,
        op12_merkle_manifest,
        op13_compression_bands,
    )
}

ORACLE_SQL: dict[str, str] = {}
