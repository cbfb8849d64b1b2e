"""Scoring rows as they arrive.

Preparation stages and models are stateless once fitted, so the batch plan is
the streaming plan; the query needs no watermark and keeps no state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(rows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Append the scores of a streaming frame to a parquet table, exactly once.

    The query takes what is there and ends (``availableNow``); run it again for
    the rows that came since.
    """
    return (
        score(rows)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
