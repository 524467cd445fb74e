"""Waves from Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.graph import Graph


def stream_graph(graph: Graph, root: str, changes: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, name: str | None = None, **trigger) -> StreamingQuery:
    """Feeds each micro-batch of ``changes`` (after ``prepare``, which gives type, key, value, ordinal) to a root
    as one wave. The version that a batch makes remembers its number under the stream's name (by default the
    checkpoint), so a batch that is sent again, by this process or a later one, is skipped."""
    name = name or checkpoint

    def run(batch: DataFrame, number: int) -> None:
        newest = max(graph.store.versions(graph.spark), default=0)
        done = graph.store.manifest(graph.spark, newest)["streams"].get(name, -1) if newest else -1
        if done < number:
            graph.update({root: prepare(batch)}, stream=(name, number))

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
