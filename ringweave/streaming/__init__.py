"""Line sources that don't end: the same jobs on a stream, with per-batch results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ringweave.sources.lines import lines


def line_stream(spark: SparkSession, folder: str, kind: str = "string") -> DataFrame:
    """Lines of the text files that arrive in a folder, typed."""
    return lines(spark.readStream.text(folder), "value", kind)


def run_stream(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Hands each batch to handle(rows, number); a restart goes on from the checkpoint's last batch."""
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running(df: DataFrame, keys: list[str], aggregates: list, name: str, checkpoint: str) -> StreamingQuery:
    """A running reduction by key, as an in-memory table that holds the latest stores."""
    return df.groupBy(*keys).agg(*aggregates).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
