"""The thin queries op1 to op13: each applies its operator to the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import base, bpe, exact, license_scan, mixing, prefix_trie, quality, secret_scan, sharding, simhash, spelling, tiff, token_files, toxicity
from .common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_words"]
    return license_scan.scan(documents(spark, sf_dir)).select(*columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), ids=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(documents(spark, sf_dir))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_license_scan": op2_license_scan,
    "op3_quality": op3_quality,
    "op4_secret_scan": op4_secret_scan,
    "op5_token_files": op5_token_files,
    "op6_bpe": op6_bpe,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_tiff": op10_tiff,
    "op11_spelling": op11_spelling,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_prefix_trie": op13_prefix_trie,
} | base.QUERIES

#: Queries that SQL can express; the others have brute-force tests in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op11_spelling": spelling.ORACLE,
    "op12_exact_dedup": exact.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
} | base.ORACLE_SQL
