"""The registered queries of this subpackage: opN_<name> over whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html, lengths, packing, pii, preference, quality, secrets, simhash, sql, warc, winnow
from .common import table


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents")))


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_preferences(preference.pair_replies(table(spark, sf_dir, "conversations")))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digest(winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_histogram(lengths.encoded_lengths(table(spark, sf_dir, "documents")))


def op7_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op8_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_pii_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.read_bundles(warc.write_bundles(table(spark, sf_dir, "pages")), payloads=False))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_distribution_divergence, op2_vector_packing, op3_simhash_near_duplicates, op4_preference_pairs, op5_winnowing, op6_length_histogram, op7_secret_randomness, op8_html_tree_scoring, op9_pii_boosted_trees, op10_warc_bundles)}


def oracle_sql() -> dict[str, str]:
    return {"op1_distribution_divergence": sql.QUALITY, "op4_preference_pairs": preference.SQL, "op5_winnowing": sql.CONTAMINATION}
