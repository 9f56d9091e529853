"""Samples as a stream: each micro-batch goes through a pipeline and into a result table, once per content key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.cache import through


def score_stream(stream: DataFrame, pipeline: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, key: str = "key") -> StreamingQuery:
    """Start a query that takes what is there and ends; a batch that is run again finds its keys in the table and adds nothing."""

    def each(batch: DataFrame, _: int) -> None:
        through(batch.dropDuplicates([key]), results, pipeline, key).select(key).write.format("noop").mode("overwrite").save()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
