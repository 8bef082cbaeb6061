"""The mergeable statistics over streams: the same aggregates, kept up to date by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import col, normalize, number


def _moments(value: str) -> list:
    v = number(value)
    return [F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v.isNull()).alias("missing")]


def running_profile(stream: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Statistics since the start; for outputMode complete or update."""
    return normalize(stream).groupBy(*[col(c) for c in by or []]).agg(*_moments(value))


def windowed_profile(stream: DataFrame, time: str, value: str, window: str = "1 day", slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Statistics per tumbling or sliding window of event time; rows later than the watermark are dropped."""
    rows = normalize(stream).withColumn("_t", col(time).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", window, slide) if slide else F.window("_t", window)
    out = rows.groupBy(w.alias("w"), *[col(c) for c in by or []]).agg(*_moments(value))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def session_profile(stream: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = stream.withColumn("_t", col(time).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(F.session_window("_t", gap).alias("w"), *[col(c) for c in by]).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def distinct_events(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return stream.withColumn(time, col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def write_profile(profile: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "complete", every: str | None = None) -> StreamingQuery:
    """Each batch of the profile goes to sink(df, batch id); state is recovered from the checkpoint folder."""
    writer = profile.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
