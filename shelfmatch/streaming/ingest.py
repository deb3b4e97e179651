"""Add-if-absent loading of a vector table from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from shelfmatch.sources.store import VectorTable


def ingest(rows: DataFrame, table: VectorTable, checkpoint: str) -> StreamingQuery:
    """Each micro-batch appends the ids that the table doesn't have yet, so a repeated batch changes nothing."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: table.add(batch)).start()
