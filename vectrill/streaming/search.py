"""Searches for a stream of queries against a static index, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.index import VectorIndex


def search_stream(index: VectorIndex, queries: DataFrame, sink: Callable[[DataFrame, int], None], k: int, clusters_to_search: int, points_to_rerank: int) -> DataStreamWriter:
    """A writer to start; ``sink`` gets each batch's result and its number. No state is kept between batches."""
    return queries.writeStream.foreachBatch(lambda df, n: sink(index.search(df, k, clusters_to_search, points_to_rerank), n))
