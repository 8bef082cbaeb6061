"""Training-data pipeline over documents: each stage's rows are written as Parquet and read again as the next one's documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and columns of any name; what
it does with them its function says. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import packing, quality, secrets, simhash, winnow
from plumbline.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that fail the base rules or lie too far from their language; null and empty texts go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each component of near-duplicates; wordless texts are copies of each other."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the texts that hold a passage of the benchmark; rows with a null id stay."""
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets replaced by [SECRET:kind]; null texts stay null."""
    return secrets.redact(docs)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every document with its sequence and offset; null texts are the end-of-document id alone."""
    return packing.digest(packing.pack_documents(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("packing", token_packing),
]

#: SQL has neither the tokenizer nor 64-bit xxHash; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what they write lies in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
