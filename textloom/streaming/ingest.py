"""Incremental indexing from a stream: each micro-batch is an upsert, visible when it is committed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.index import PENDING_ROWS, SearchIndex


def ingest(stream: DataFrame, index: SearchIndex, checkpoint: str, key: str = "doc_id", text: str = "text", flush_rows: int = PENDING_ROWS, **trigger) -> StreamingQuery:
    """Writes a stream into the index; a batch that is replayed replaces its own rows.

    Segments are merged by size class when pending rows pass flush_rows.
    """

    def batch(rows: DataFrame, _: int) -> None:
        index.refresh()
        index.upsert(rows, key, text)
        if sum(s["docs"] for s in index.manifest["segments"] if s["pending"]) > flush_rows:
            index.flush()
            index.compact(tiered=True)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
