"""Streams of quads into a store: each micro-batch is a bulk write, optionally followed by reasoning over the changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..graph import Graph


def ingest(stream: DataFrame, graph: Graph, checkpoint: str, after: Callable[[Graph, DataFrame], None] | None = None, trigger: dict | None = None):
    """Starts a query that adds the stream's quads (s, p, o, g) to the graph; `after` sees the graph and each batch. Set semantics make a repeated batch harmless."""

    def write(batch: DataFrame, _epoch: int) -> None:
        graph.store.insert(batch.select("s", "p", "o", "g"))
        if after is not None:
            after(graph, batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
