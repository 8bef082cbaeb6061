"""Fits the language references of quality.py: python -m plumbline.llm.quality_references FOLDER

Pools the histograms of at most FIT_ROWS rows labelled good, per language, and writes quality_references.json. Rows with
an odd id are held back: the tests judge the operator on them. The file says what it was fitted on.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .quality import CLASSES, COMMON_WORDS, FIT_ROWS, MIN_WORDS, class_counts, common_counts


def fit(spark: SparkSession, folder: str) -> dict:
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1 and toxic = 0 and doc_id % 2 = 0").orderBy("doc_id").limit(FIT_ROWS)
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels, "doc_id", "left_semi").where(F.col("lang").isin(*COMMON_WORDS))
    in_words = F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""))
    rows = docs.where(F.size(F.split("text", r"[\x20\x09-\x0D]+")) >= MIN_WORDS).select("lang", class_counts(F.col("text"), in_words).alias("chars"), common_counts(F.col("text"), F.col("lang")).alias("words"))
    out: dict[str, dict[str, list[float]]] = {}
    for kind, width in (("chars", len(CLASSES)), ("words", 21)):
        for r in rows.groupBy("lang").agg(F.array(*[F.sum(F.col(kind)[i]) for i in range(width)]).alias("sums")).collect():
            out.setdefault(r.lang, {})[kind] = [round(v / sum(r.sums), 6) for v in r.sums]
    return {"fitted_on": {"folder": Path(folder).name, "rows": rows.count(), "held_back": "odd doc_id"}, "languages": dict(sorted(out.items()))}


if __name__ == "__main__":
    session = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    Path(__file__).with_name("quality_references.json").write_text(json.dumps(fit(session, sys.argv[1]), indent=1) + "\n")
