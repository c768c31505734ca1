"""The row-local cleaning of post.py on a stream of packed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexweave.operators import post


def clean_stream(rows: DataFrame) -> DataFrame:
    """Clean, then drop errors and empty texts; no state, so no watermark is needed."""
    return post.drop_empty(post.drop_errors(post.clean(rows)))


def dedup_stream(rows: DataFrame, time_col: str = "loaded_at", late: str = "1 day") -> DataFrame:
    """The first row of each text within the watermark; state is dropped behind it."""
    return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["text"])


def write(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run until the input that is there now is done."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
