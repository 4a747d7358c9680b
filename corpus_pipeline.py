"""Corpus preparation from documents: toxicity, near-duplicates, secrets, mixing, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; all but
the last return the columns of documents.

Edge cases: null and wordless texts are clean, near-duplicates of each other, without secrets, of size 0
(a mix takes them with their block) and encode to nothing; repeated rows become one row with the
near-duplicates, repeated ids of other texts stay rows of their own; ties are settled as the operators
say; very long texts are whole in every stage; empty tables pass through; extra columns of any name are
carried to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import bpe, mixing, secret_scan, simhash, toxicity
from turnlake.llm.common import compact, documents, remove, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from labels of rows not held out."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts."""
    masked = compact(secret_scan.redact(docs), docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them, in the order of the mix."""
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe.encode(docs, ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scan", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL has no SimHash, Levenshtein automata or BPE; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage has read
    goes once its own rows are written."""
    docs, folder = documents(spark, sf_dir), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
