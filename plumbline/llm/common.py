"""Shared plumbing of the corpus operators: table access, shared-folder tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was measured and has at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a temporary one is set, in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plumbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row: its numbers, texts and lists."""
    total = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
        elif kind == "array<string>":
            total = total + F.coalesce(F.aggregate(F.col(name), F.lit(0), lambda a, x: a + 16 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
        elif kind.startswith("array"):
            total = total + 16 * F.greatest(F.size(name), F.lit(0))
    return total.cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its measured rows and bytes stay within the limits, else df as it is (both sides are shuffled)."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_bytes(df)), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found["n"] <= rows and found["b"] <= size else df


def join_counted(rows: DataFrame, side: DataFrame, key: str, count: str, hot: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with side, which has one row per key and the number of rows of that key.

    A small side is broadcast. Else keys of more than hot rows, of which there is at most one in hot rows, are broadcast
    and the others shuffled, so no task gathers the rows of a hot key.
    """
    whole = small(side)
    if whole is not side:
        return rows.join(whole, key, how)
    few, many = small(side.where(F.col(count) > hot)), side.where(F.col(count) <= hot)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(many, key, how))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once: a lambda variable, which the optimizer can't copy into every use."""
    return F.transform(F.array(value), body)[0]


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever other columns the table brings along."""
    return df.select(*[df[n] for n in names])
