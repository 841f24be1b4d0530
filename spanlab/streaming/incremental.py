"""Incremental scoring of arriving documents. An extension: the batch evaluation has no streams.

Each micro-batch is chunked and scored by itself and appended; statistics over a whole run stay with the batch queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.operators.chunkers import chunk
from spanlab.operators.structural import sizes


def score_arrivals(arrivals: DataFrame, out: str, checkpoint: str, strategies: list[str], then: Callable[[DataFrame], DataFrame] = sizes):
    """arrivals: a stream of document_id, text. Starts a query that appends a row for each strategy and document to out."""

    def batch(rows: DataFrame, epoch: int) -> None:
        chunks = chunk(rows, strategies).withColumn("char_count", F.length("text"))
        # The batch's number is part of the path, so that a batch that is run again replaces itself.
        then(chunks).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
