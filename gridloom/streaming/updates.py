"""Streams of cells into an array (an extension: the array model itself has no streams).

Each micro-batch's cells are merged into the stored chunks that they touch. Spark runs the batches of one query one after the other, so every chunk has one
writer at a time; the last write of a cell within a batch is the one with the largest `order` value, and replayed batches write the same cells again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.sources.arrays import read_node, update_cells
from gridloom.sources.store import SparkStore


def merge_cells(store: SparkStore, path: str, cells: DataFrame, order: str | None = None) -> int:
    """Writes cells (i0.., v) into the stored array; only the chunks that they touch are read and written. The number of (inner) chunks encoded."""
    names = [f"i{k}" for k in range(read_node(store, path).dims)]
    latest = cells.groupBy(*names).agg((F.max_by("v", order) if order else F.max("v")).alias("v"))
    return update_cells(store, path, latest)


def stream_cells(cells: DataFrame, store: SparkStore, path: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Starts a query that merges a stream of cells into an array."""
    return cells.writeStream.foreachBatch(lambda batch, _: (merge_cells(store, path, batch, order), None)[1]).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
