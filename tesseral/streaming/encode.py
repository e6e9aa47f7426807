"""Exact encoding of chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tensors


def encode_stream(chunks: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """Writes a stream of chunks (tensor_id, chunk_id, dtype, payload) as exact payloads in Parquet.

    Each chunk is encoded by itself, so there is no state; the sink's log and the
    checkpoint make each chunk occur once however often a batch is run again.
    """
    writer = tensors.encode_chunks(chunks).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def strategy_counts(encoded: DataFrame, *, at: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Chunks and bytes by strategy in tumbling windows of event time, closed once `late` has passed."""
    timed = encoded.withWatermark(at, late).groupBy(F.window(at, window), "strategy")
    return timed.agg(F.count("*").alias("chunks"), F.sum("raw_bytes").alias("raw_bytes"), F.sum(F.octet_length("encoded")).alias("encoded_bytes"))
