"""The causal skeleton on a stream of edges: each micro-batch adds to the stored states of its own links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from causeway.operators import consensus as K
from causeway.sources.tables import StoredTable


def state_table(spark, path: str, buckets: int = 64) -> StoredTable:
    return StoredTable.create(spark, path, K.SCHEMA, K.KEY, buckets)


def refresh(edges: DataFrame, table: StoredTable, checkpoint: str, writer: str = "edges") -> StreamingQuery:
    """Starts a query that merges the states of each micro-batch into ``table``; ``K.links`` of the table are the graph.

    Only the buckets of links that a batch has are rewritten, and a batch that comes again after a failure is skipped.
    """

    def take(batch: DataFrame, number: int) -> None:
        table.merge(K.states(batch), batch=(writer, number), combine=K.merged)

    return edges.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
