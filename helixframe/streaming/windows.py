"""Windows over event streams (ts, ...) with watermarks: late rows beyond the delay are dropped, state is bounded by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, delay: str) -> DataFrame:
    """``events`` with ts as a timestamp under a watermark of ``delay``."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, size: str, delay: str, *keys: str) -> DataFrame:
    """start, keys, n of windows that follow each other."""
    return sliding(events, size, size, delay, *keys)


def sliding(events: DataFrame, size: str, step: str, delay: str, *keys: str) -> DataFrame:
    """start, keys, n of windows of ``size`` that begin every ``step``."""
    counted = timed(events, delay).groupBy(F.window("ts", size, step).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, delay: str, key: str) -> DataFrame:
    """key, start, n of runs of a key's events with no ``gap`` between them."""
    counted = timed(events, delay).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def deduplicated(events: DataFrame, key: str, delay: str) -> DataFrame:
    """The first event of each key; keys are forgotten after the watermark."""
    return timed(events, delay).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run over what is there now, exactly once: offsets and state live in ``checkpoint``, Parquet commits by its log."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
