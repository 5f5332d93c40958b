"""Clusters of a stream of points.

Counts and sums of a cell add up, so they run as a streaming aggregation; the merge, which needs all cells in order, runs on
each trigger's cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import cells as c
from ..operators.clustering import _finished, merge
from ..plans.params import ClusterParams


def stream_cells(stream: DataFrame, lat: str, lon: str, params: ClusterParams, *, by: Sequence[str] = (), time: str | None = None, window: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Running counts and centroids of cells; with a time column and a window, of each window, closed once `late` has passed."""
    by = list(by)
    if window:
        if not time:
            raise ValueError("a window needs a time column")
        stream = stream.withWatermark(time, late).withColumn("window", F.window(time, window))
        by = ["window", *by]
    return c.aggregate(c.located_columns(stream, lat, lon, params.level), by)


def write_clusters(cells: DataFrame, params: ClusterParams, sink: Callable[[DataFrame, int], None], *, by: Sequence[str] = (), mode: str = "complete") -> DataStreamWriter:
    """A writer that hands each trigger's clusters to sink(clusters, trigger).  Mode complete: of all cells so far; append (with windows): of closed windows."""
    by = list(by)

    def on_trigger(batch: DataFrame, number: int) -> None:
        clusters = merge(c.greatest(batch, params.size, by), params, by)
        sink(_finished(clusters, params.level, by, {}), number)

    return cells.writeStream.outputMode(mode).foreachBatch(on_trigger)
