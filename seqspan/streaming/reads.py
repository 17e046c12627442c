"""Reads that arrive as a stream, searched against a static index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqspan.config import QueryConfig
from seqspan.operators.hierarchy import SequenceIndex
from seqspan.operators.search import routed


def search_stream(reads: DataFrame, index: SequenceIndex, output: str, checkpoint: str, config: QueryConfig = QueryConfig()) -> StreamingQuery:
    """Starts a query that writes each micro-batch's hits to ``output/batch=<n>``; a batch that
    is repeated after a failure overwrites its own folder only."""

    def one_batch(batch: DataFrame, number: int) -> None:
        routed(batch, index, config).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return reads.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).start()
