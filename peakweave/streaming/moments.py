"""Moments of regions kept up over a stream of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_region_sums(counts: DataFrame) -> DataFrame:
    """(idx, n, sx, sxx) over a streaming (or plain) counts table; state has a row a region."""
    return counts.groupBy("idx").agg(F.count("*").alias("n"), F.sum("value").alias("sx"), F.sum(F.col("value") * F.col("value")).alias("sxx"))


def start_region_sums(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run the sums over all data that is there as an in-memory table; the checkpoint folder must be shared."""
    return stream_region_sums(counts).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
