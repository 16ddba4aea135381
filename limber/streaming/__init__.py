"""Incremental indexing with Structured Streaming (an extension to indexing in batches).

Each micro-batch becomes a version of the index, named by the stream and the
batch's number, so that a batch which runs again after a failure is not added
twice, and readers see whole batches. Rows are passed on as they are, nulls and
repeats too; a stream without rows adds none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from limber.operators.index import append_index


def append_features(stream: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream of index rows has to the index and stop; rows already taken are not taken again."""

    def append(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            append_index(rows, index_path, (checkpoint, number))

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
