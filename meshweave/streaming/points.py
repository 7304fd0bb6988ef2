"""Streams of points against a static mesh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import point_in_mesh


def stream_point_in_mesh(points: DataFrame, triangles: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run the point query on each micro-batch and hand its result to ``sink``; each batch is complete in itself."""
    return points.writeStream.foreachBatch(lambda batch, n: sink(point_in_mesh(batch, triangles), n)).option("checkpointLocation", checkpoint).start()
