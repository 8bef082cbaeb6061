"""Exact histogram of encoded document lengths, with suffix sums that answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, require
from .tokens import shared_encoder

#: Lengths of a block of the two-level sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, *, vocabulary: str | None = None, extra: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens: the whole text's ids plus extra (the end-of-document id). Null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = shared_encoder(vocabulary)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            sizes: list[int] = []
            for at in range(0, len(texts), 256):
                sizes += [len(x) // 4 + extra for x in encoder.encode(texts[at : at + 256])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": sizes})

    rows = require(docs, id_column, text_column).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, with what a context limit of that length keeps.

    n_docs, n_tokens: documents of the length and their tokens. docs_at_least, tokens_at_least: suffix sums.
    total_tokens: of all documents. truncated_total: tokens left if each document is cut at the length. rank_high: the
    documents of at most the length, so the q-quantile is the first row with rank_high >= q * total_docs.
    Every partial count is combined before the shuffle. Sums run within blocks of lengths, then over the blocks, so no
    task holds more than a block or the short list of blocks. No documents: no row.
    """
    counts = lengths.where(F.col("n_tokens").isNotNull()).groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    # One short row per length: written once, as the blocks' sums and the rows both need it.
    counts = materialize(counts).withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("n_tokens").alias("b_tokens"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("b_docs").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("b_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("b_docs").over(everything).alias("total_docs"), F.sum("b_tokens").over(everything).alias("total_tokens"),
    )
    suffix = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.join(blocks, "block").withColumns({"docs_at_least": F.sum("n_docs").over(suffix) + F.col("docs_above"), "tokens_at_least": F.sum("n_tokens").over(suffix) + F.col("tokens_above")})
    shorter_tokens = F.col("total_tokens") - F.col("tokens_at_least")
    return rows.select(
        "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least", "total_docs", "total_tokens",
        (shorter_tokens + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("rank_high"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left if each document is cut at limit, from the suffix sums of the first length above it."""
    above = histogram.where(F.col("length") > limit).orderBy("length").limit(1)
    kept = above.select((F.col("total_tokens") - F.col("tokens_at_least") + limit * F.col("docs_at_least")).alias("kept"))
    everything = histogram.select(F.col("total_tokens").alias("kept")).limit(1)
    return kept.unionByName(everything).agg(F.coalesce(F.min("kept"), F.lit(0)).alias("truncated_total"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row at most: the least length that q of the documents don't exceed (no row without documents)."""
    return histogram.where(F.col("rank_high") >= F.greatest(F.ceil(q * F.col("total_docs")), F.lit(1))).agg(F.min("length").alias("length")).where("length is not null")
