"""Ordered ingestion of token chunks: every chunk follows the one before without a gap, and nothing follows the last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class ChunkOrderError(ValueError):
    pass


class ChunkLog:
    """What has arrived so far; ``accept`` raises on a chunk out of order, a gap, or a chunk after the last."""

    def __init__(self, chunk_id: int = 0, offset: int = 0, closed: bool = False):
        self.chunk_id, self.offset, self.closed = chunk_id, offset, closed

    def accept(self, chunk_id: int, offset: int, tokens: int, is_last: bool) -> None:
        if self.closed:
            raise ChunkOrderError(f"chunk {chunk_id} after the last chunk")
        if chunk_id != self.chunk_id:
            raise ChunkOrderError(f"chunk {chunk_id} where {self.chunk_id} was expected")
        if offset != self.offset:
            raise ChunkOrderError(f"chunk {chunk_id} starts at {offset}, not at {self.offset}")
        self.chunk_id, self.offset, self.closed = chunk_id + 1, offset + tokens, is_last


def ingest(stream: DataFrame, target: str, checkpoint: str, log: ChunkLog | None = None) -> StreamingQuery:
    """Append a stream of token rows with chunk_id, token_offset and is_last to ``target``, in order.

    Per micro-batch only one row a chunk reaches the driver, for the order check. Rows are written under the batch's
    number, so a repeated batch replaces what it wrote before.
    """
    log = log or ChunkLog()

    def write(batch: DataFrame, number: int) -> None:
        chunks = batch.groupBy("chunk_id").agg(F.min("token_offset").alias("token_offset"), F.count("*").alias("n"), F.max("is_last").alias("is_last")).orderBy("chunk_id")
        for r in chunks.collect():
            log.accept(r["chunk_id"], r["token_offset"], r["n"], bool(r["is_last"]))
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
