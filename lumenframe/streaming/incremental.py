"""Streaming front ends: item statistics over a stream of ratings, a k-means sketch kept across micro-batches.

The library's algorithms read bounded tables; these keep the same results up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lumenframe.operators import clustering, similarity


def streaming_item_stats(ratings: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``item_stats`` of a stream of (user, item, rating) in the in-memory table ``name``."""
    return similarity.item_stats(ratings).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def streaming_sketch(points: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends each micro-batch's one-pass sketch to ``path``; ``ball_kmeans`` reads them all.

    A batch writes a folder of its own, so one that is retried after a failure replaces itself.
    """

    def fold(batch: DataFrame, number: int) -> None:
        clustering.one_pass(batch, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).start()
